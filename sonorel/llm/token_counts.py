"""Token counts by an exact length histogram.

Documents are aggregated by encoded length. Suffix sums over the histogram then
answer, for every context limit: the documents and tokens at or beyond it, the
total when documents are truncated to it, and the share of documents that fit.
Sums run in two levels, over blocks of lengths and within a block, so no task
gets more than a block's lengths or the list of blocks.

Null text counts as empty, with length 0. An empty table gives no rows. Other
columns are not read; repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonorel.llm.bpe import load, small_batches
from sonorel.llm.common import bound_arrow_batches, materialize

BLOCK = 1024


def lengths(docs: DataFrame, path: str) -> DataFrame:
    """length of each document's encoding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole):
                found = load(path).encode_packed(batch.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([len(x) // 4 for x in found], pa.int64())], ["length"])

    bound_arrow_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "length bigint")


def histogram(measured: DataFrame) -> DataFrame:
    return measured.groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """One row per occurring length, taken as a context limit: n_docs of that
    length, docs_at_least / tokens_at_least (length or more), docs_at_most,
    total_tokens, truncated_tokens (sum of min(length, limit)), share_at_most."""
    h = hist.select(
        "length",
        "n_docs",
        (F.col("length") * F.col("n_docs")).alias("tokens"),
        F.floor(F.col("length") / BLOCK).alias("block"),
    )
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("bd").over(later), F.lit(0)).alias("docs_later"),
        F.coalesce(F.sum("bt").over(later), F.lit(0)).alias("tokens_later"),
        F.sum("bd").over(whole).alias("all_docs"),
        F.sum("bt").over(whole).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    out = h.withColumns({"d": F.sum("n_docs").over(inside), "t": F.sum("tokens").over(inside)}).join(blocks, "block")
    at_least, tokens_at_least = F.col("d") + F.col("docs_later"), F.col("t") + F.col("tokens_later")
    at_most = F.col("all_docs") - at_least + F.col("n_docs")
    return out.select(
        F.col("length").alias("context_limit"),
        "n_docs",
        at_least.alias("docs_at_least"),
        tokens_at_least.alias("tokens_at_least"),
        at_most.alias("docs_at_most"),
        "total_tokens",
        (F.col("total_tokens") - tokens_at_least + F.col("length") * at_least).alias("truncated_tokens"),
        (at_most / F.col("all_docs")).alias("share_at_most"),
    )


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """The sums read the histogram twice, so it is written first: texts are encoded once."""
    return suffix_sums(materialize(histogram(lengths(docs, path)), "lengths"))


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Total of min(length, limit) over all documents, for any limit."""
    low = sums.agg(F.max("total_tokens").alias("t"), F.max("docs_at_least").alias("n")).first()
    after = sums.where(F.col("context_limit") >= limit).orderBy("context_limit").select("docs_at_least", "tokens_at_least").first()
    if low.t is None:
        return 0
    return low.t if after is None else low.t - after.tokens_at_least + limit * after.docs_at_least


def quantile(sums: DataFrame, q: float) -> int | None:
    """The smallest length that at least a share q of the documents doesn't exceed."""
    row = sums.where(F.col("share_at_most") >= q).agg(F.min("context_limit")).first()
    return row[0]
