"""Whole stages: streams of frames in, streams of frames out, over the operators beside."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorel.operators import external
from sonorel.operators import frames as R
from sonorel.operators.profile import numbered
from sonorel.sources import records, wav


def checked_stream(spark: SparkSession, path: str) -> DataFrame:
    """The frames of a file or folder. Ids under which different frames go are refused, as later stages tell frames apart by them."""
    frames = records.read_frames(spark, path)
    wrong = R.duplicate_ids(frames).orderBy("id").limit(5).collect()
    if wrong:
        raise ValueError(f"id_collision: different frames share {', '.join(r.id for r in wrong)}")
    return frames


def audio_of(files: DataFrame, role: Column, op: str, params: Column) -> DataFrame:
    """A frame for each file, in order of path: audio of its samples' hash, or the error that decoding gave. files: path, content."""
    found = wav.decoded(files).select("path", "signal_id", "sr", "ch", "n", "error")
    found = numbered(found, [F.col("path")], "pos").withColumn("pos", F.col("pos") - 1)
    good = R.audio_frames(
        found.where("error is null"),
        F.col("signal_id"),
        F.col("sr"),
        F.col("ch"),
        F.col("n") / F.col("sr"),
        fmt=F.lit("WAV"),
        role=role,
        op=F.lit(op),
        op_version=F.lit(f"{op}@1"),
        params=F.to_json(params),
        pos=F.col("pos"),
    )
    bad = found.where("error is not null")
    message = F.concat_ws(": ", "path", F.regexp_replace("error", "^decode_failed: ", ""))
    none = F.lit(None).cast("string")
    wrong = R.error_frame(
        bad.withColumn("message", message),
        F.lit("decode_failed"),
        F.col("message"),
        none,
        F.lit(op),
        F.col("pos"),
    )
    return good.unionByName(wrong)


def read_stage(files: DataFrame, role: str = "source", inbound: DataFrame | None = None) -> DataFrame:
    """The inbound stream, followed by a frame for each file."""
    made = audio_of(files, F.lit(role), "read", F.struct(F.col("path").alias("source")))
    return made if inbound is None else R.passthrough(inbound, made)


def from_wav(files: DataFrame, role: str = "from-wav", derives_from: str | None = None) -> DataFrame:
    """Frames of raw bytes. What they come from is told in params, and is no lineage: there is no frame that it could name."""
    told = [F.col("signal_id").alias("input_hash"), F.lit("raw-wav-bridge").alias("via")]
    if derives_from is not None:
        told.append(F.lit(derives_from).alias("derives_from"))
    return audio_of(files, F.lit(role), "from-wav", F.struct(*told))


def write_stage(
    frames: DataFrame,
    signals: DataFrame,
    out: str,
    role: str | None = None,
    strict: bool = False,
    encoding: str = "FLOAT",
) -> DataFrame:
    """Writes the last audio frame of the role as a file, and passes the stream on. signals: schema.SIGNAL. Strict: the only one, or an error."""
    if strict and R.matching(frames, role, "audio").limit(2).count() > 1:
        raise ValueError(f"strict: several audio frames match {role or 'audio'}")
    chosen = R.resolve_audio(frames, role).first()
    if chosen.hash is None:
        raise LookupError(f"{chosen.code}: {chosen.message}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = fs.FileSystem.from_uri(out)
        for batch in batches:
            for raw in batch.column(1).to_pylist():
                files.create_dir(path.rpartition("/")[0], recursive=True)
                with files.open_output_stream(path, compression=None) as stream:
                    stream.write(raw)
            yield batch.select([0])

    found = wav.encoded(signals.where(F.col("signal_id") == chosen.hash).limit(1), encoding)
    if not found.mapInArrow(write, "signal_id string").collect():
        raise LookupError(f"not_found: no samples of {chosen.hash}")
    return frames


def verdict_stage(
    axes: DataFrame,
    judged: DataFrame,
    by: list[str],
    name: Column,
    features: Column,
    profile: str,
    schema_version: str,
) -> DataFrame:
    """A verdict frame for each judged candidate. axes: by..., key, value, median, z, band; judged: by..., decision,
    confidence, reason, score, worst. features: an array of the feature frames' ids; the profile's token follows them in
    the lineage."""
    axis = F.struct("key", "value", "median", "z", "band")
    rows = axes.groupBy(*by).agg(F.array_sort(F.collect_list(axis)).alias("axes")).join(judged, by)
    data = F.struct(
        F.struct("decision", "confidence", "reason", "score", F.col("worst").alias("dominant")).alias("rollup"),
        F.col("axes"),
    )
    lineage = F.concat(features, F.array(F.lit(profile)))
    return R.verdict_frames(
        rows,
        data,
        name,
        lineage,
        F.lit(schema_version),
        role=F.concat(F.lit("candidate:"), name),
        op=F.lit("verdict"),
        op_version=F.lit("verdict@1"),
    )


def embed_stage(signals: DataFrame, dim: int = 64, model: str = "spectral-projection") -> DataFrame:
    """A vector frame for each signal, of its content."""
    made = external.embed(signals, dim)
    return R.vector_frames(
        made,
        F.lit(model),
        F.lit(dim),
        F.col("vector"),
        of=F.col("signal_id"),
        op=F.lit("embed"),
        op_version=F.lit("embed@1"),
    )
