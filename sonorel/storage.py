"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: list[str] = []
#: Bytes of a table's values up to which it is broadcast.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the setting is absent and Spark runs on this machine alone, as in tests, a
    folder of our own is made and removed at exit. On a cluster that is an error: the
    executors would not see the driver's folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and the executors of {master} share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="sonorel-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def tables_dir(spark: SparkSession) -> str:
    """Where this application's written tables are."""
    return f"{shared_dir(spark)}/sonorel/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{tables_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage with
    files that outlive any executor, and freezes generated ids."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear_tables(spark: SparkSession) -> None:
    """Removes all tables that this application wrote on the way: call it when their results have been read."""
    remove(spark, tables_dir(spark))


def column(name: str, of: str = "") -> Column:
    """A column by its very name, whatever characters that has; of: the struct that it is a field of."""
    quoted = "`" + name.replace("`", "``") + "`"
    return F.col(f"{of}.{quoted}" if of else quoted)


def value_bytes(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
            total = F.aggregate(value, F.lit(0), lambda a, x: a + value_bytes(x, inner))
        else:
            total = F.size(value) * 8
        return F.coalesce(total, F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return sum((value_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(8))
    return F.lit(8)


def broadcast_if_small(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hints a broadcast where the values of the (materialized) table are measured to take few bytes; otherwise leaves the join to a shuffle."""
    row = sum((value_bytes(column(f.name), f.dataType) for f in df.schema.fields), F.lit(8))
    size = df.agg(F.sum(row.cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= most_bytes else df
