"""The operators' queries over the standard tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorel.llm.common import fresh_path, table

SHARDS = 40


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonorel.llm.sharding import shard_documents

    out = shard_documents(table(spark, sf_dir, "documents"), SHARDS, map_path=fresh_path(spark, "slot-map"))
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonorel.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonorel.llm.warc import read_warc, write_warc

    path = fresh_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    back = read_warc(spark, path, ("response", "revisit"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonorel.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonorel.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonorel.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonorel.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonorel.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", 10)


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonorel.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonorel.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f for f in (
            op1_sharding,
            op2_pii,
            op3_warc,
            op4_bpe,
            op5_quality,
            op6_token_counts,
            op7_line_dedup,
            op8_neighbours,
            op9_jaccard,
            op10_packing,
        )
    }


def oracle_sql() -> dict[str, str]:
    """The other queries can't be put in SQL; tests hold them against brute force."""
    from sonorel.llm import jaccard, quality, warc

    return {"op3_warc": warc.ORACLE_SQL, "op5_quality": quality.ORACLE_SQL, "op9_jaccard": jaccard.ORACLE_SQL}
