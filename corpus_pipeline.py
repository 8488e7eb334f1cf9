"""The corpus pipeline: documents in, packed training sequences out.

Every stage takes all that its predecessor kept. STAGES lists them by name.

Cases: documents without text, or of fewer than 20 words, fail the quality rules, so no
later stage sees them. Of rows that repeat an id and a text, and of texts that are
similar, one row stays: that of the smallest id, null last. Ids may repeat with
different texts. Columns besides the five of the table stay up to the packing, whatever
their names. A table without rows gives none. Texts may have any length."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sonorel.llm import jaccard, line_dedup, packing, pii, quality
from sonorel.llm.common import drop_table, materialize, table
from sonorel.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("ngram_jaccard", near_duplicates),
    ("pii", personal_data),
    ("packing", pack_sequences),
]

#: Tokenising and packing can't be put in SQL; a test holds each stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's table is removed once the next one is written."""
    docs, written = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if written is not None:
            drop_table(spark, written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
