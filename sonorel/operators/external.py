"""The seam for further operators: a registry of named verbs, processes that read and write rows, and models that aren't here."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonorel.operators.features import decode_row
from sonorel.operators.frames import frame

Verb = Callable[..., DataFrame]
VERBS: dict[str, Verb] = {}
#: Operators that need a model or a program that this engine doesn't bring.
ABSENT = ("stems", "transcribe", "transcribe-midi", "render-midi", "cloud", "synth")


def verb(name: str) -> Callable[[Verb], Verb]:
    """Registers a DataFrame operator under a name."""

    def put(f: Verb) -> Verb:
        if name in VERBS:
            raise ValueError(f"{name} is taken")
        VERBS[name] = f
        return f

    return put


def run(name: str, df: DataFrame, **how) -> DataFrame:
    """A registered verb; for one that is known but absent, an error frame (code unsupported) for each audio frame."""
    if name in VERBS:
        return VERBS[name](df, **how)
    if name in ABSENT:
        return unsupported(df, name)
    raise KeyError(f"no operator is named {name}")


def unsupported(frames: DataFrame, name: str) -> DataFrame:
    data = F.to_json(
        F.struct(F.lit("unsupported").alias("code"), F.lit(f"{name} is not installed").alias("message"), F.col("id").alias("of"))
    )
    return frame(frames.where("kind = 'audio'"), pos=F.col("pos"), kind=F.lit("error"), of=F.col("id"), op=F.lit(name), data=data)


def through(rows: DataFrame, command: list[str], timeout: float = 600.0) -> DataFrame:
    """id, content, error: each row's bytes through a program's input and output."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                try:
                    done = subprocess.run(command, input=batch.column(1)[i].as_py() or b"", capture_output=True, timeout=timeout)
                    out, bad = (done.stdout, None) if done.returncode == 0 else (
                        None,
                        f"op_failed: {done.stderr[-200:].decode(errors='replace')}",
                    )
                except (OSError, subprocess.TimeoutExpired) as e:
                    out, bad = None, f"unsupported: {e}"
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), pa.array([out], pa.binary()), pa.array([bad], pa.string())],
                    ["id", "content", "error"],
                )

    return rows.select(F.col("id").cast("string"), "content").mapInArrow(work, "id string, content binary, error string")


def embed(signals: DataFrame, dim: int = 64, seed: int = 0) -> DataFrame:
    """signal_id, vector: a stand-in model, a fixed random projection of the mean log spectrum of the channels' mean."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project = np.random.default_rng(seed).normal(size=(257, dim)) / 16
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                x = decode_row(batch.column(1)[i]).mean(axis=1)
                x = np.pad(x, (0, -len(x) % 512 if len(x) else 512)).reshape(-1, 512)
                out.append((np.log1p(np.abs(np.fft.rfft(x, axis=1))).mean(axis=0) @ project).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float32()))], ["signal_id", "vector"])

    return signals.select("signal_id", "pcm").mapInArrow(work, "signal_id string, vector array<float>")


def versioned(op: str, weights: Column) -> Column:
    """An operator's version, with what identifies its model."""
    return F.concat(F.lit(f"{op}+"), F.substring(F.sha2(weights.cast("binary"), 256), 1, 12))
