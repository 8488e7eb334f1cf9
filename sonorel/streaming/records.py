"""Frames as they arrive: the batch operators over Structured Streaming.

An extension: sources of frames are folders of text files, and frames carry no
event time, so the time of arrival serves for watermarks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorel.operators import profile as P
from sonorel.storage import broadcast_if_small
from sonorel.sources.records import parse_frames


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames of files as they come to a folder, with arrived, the time of arrival. A stream has no places: pos is null."""
    lines = spark.readStream.text(path).select(F.lit(None).cast("bigint").alias("pos"), "value")
    return parse_frames(lines).withColumn("arrived", F.current_timestamp())


def once_each(frames: DataFrame, within: str = "1 hour") -> DataFrame:
    """Frames without repeats of an id that arrive within the time."""
    return frames.withWatermark("arrived", within).dropDuplicatesWithinWatermark(["id"])


def event_power(events: DataFrame, length: str, hop: str, late: str) -> DataFrame:
    """Mean square of values in sliding windows of event time; late rows beyond the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, hop), "event_type").agg(
        F.count("*").alias("n"),
        F.avg(F.col("value") * F.col("value")).alias("power"),
    )


def live_axes(features: DataFrame, profile: DataFrame) -> DataFrame:
    """Scores of features as they come, against a fixed profile (a row per role and key), which is broadcast if it is measured to be small."""
    return P.score_axes(features, broadcast_if_small(profile), ["role", "key"])
