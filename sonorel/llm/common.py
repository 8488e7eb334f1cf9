"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sonorel.storage import broadcast_if_small, clear_tables, column, fresh_path, materialize, remove, shared_dir

__all__ = [
    "bound_arrow_batches",
    "broadcast_if_small",
    "clear_tables",
    "column",
    "drop_table",
    "fresh_path",
    "materialize",
    "partitions_for",
    "shared_dir",
    "table",
]

#: Rows of an Arrow batch: whole texts pass to Python, and batches are buffered on either side.
ARROW_ROWS = 1000


def drop_table(spark: SparkSession, df: DataFrame) -> None:
    """Removes the files behind a materialized table that no plan needs any more, and has the driver notice which shuffles are free."""
    for folder in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        remove(spark, folder)
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(df: DataFrame, rows: int, rows_each: int) -> int:
    """Number of shuffle partitions so that each holds about rows_each rows."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-rows // rows_each))


def bound_arrow_batches(spark: SparkSession) -> None:
    """Lowers the session's rows per Arrow batch, so that buffers outside the heap stay small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))
