"""WAV files: decoding, encoding, probing, and a table of signals from a folder."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorel.functions.identity import hashes, signal_bytes
from sonorel.operators.arrow import BATCH_BYTES, BATCH_ROWS, in_batches
from sonorel.storage import broadcast_if_small, materialize

ENCODINGS = ("PCM_16", "PCM_24", "PCM_32", "FLOAT", "DOUBLE")
GLOB = "*.{wav,flac,aiff,aif,mp3,ogg,WAV}"


def chunks(raw: bytes, whole: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(name, offset, size) of a RIFF file's chunks. whole: the file's length, if raw is only its head."""
    whole = len(raw) if whole is None else whole
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(raw):
        size = struct.unpack_from("<I", raw, at + 4)[0]
        yield raw[at : at + 4], at + 8, min(size, whole - at - 8)
        at += 8 + size + size % 2


def probe(raw: bytes, whole: int | None = None) -> dict:
    """sr, ch, n, dur, encoding: from the headers alone."""
    form = None
    for name, at, size in chunks(raw, whole):
        if name == b"fmt ":
            tag, ch, sr, _, align, bits = struct.unpack_from("<HHIIHH", raw, at)
            if tag == 0xFFFE:
                tag = struct.unpack_from("<H", raw, at + 24)[0]
            kind = {(1, 16): "PCM_16", (1, 24): "PCM_24", (1, 32): "PCM_32", (3, 32): "FLOAT", (3, 64): "DOUBLE"}.get((tag, bits))
            if kind is None:
                raise ValueError(f"format {tag} of {bits} bits isn't supported")
            form = {"sr": sr, "ch": ch, "encoding": kind, "align": align}
        elif name == b"data":
            if form is None:
                raise ValueError("data before its format")
            n = size // form["align"]
            return form | {"n": n, "dur": n / form["sr"], "at": at}
    raise ValueError("no data")


def decode(raw: bytes) -> tuple[np.ndarray, int]:
    """float32 samples (n, channels) in -1..1, and the rate."""
    p = probe(raw)
    body = raw[p["at"] : p["at"] + p["n"] * p["align"]]
    match p["encoding"]:
        case "FLOAT":
            x = np.frombuffer(body, "<f4")
        case "DOUBLE":
            x = np.frombuffer(body, "<f8").astype(np.float32)
        case "PCM_16":
            x = np.frombuffer(body, "<i2").astype(np.float32) / np.float32(1 << 15)
        case "PCM_32":
            x = (np.frombuffer(body, "<i4") / float(1 << 31)).astype(np.float32)
        case _:
            b = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
            x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / np.float32(1 << 23)
    return x.reshape(-1, p["ch"]), p["sr"]


def encode(x: np.ndarray, rate: int, encoding: str = "FLOAT") -> bytes:
    """A WAV file of (n, channels) samples."""
    tag, bits = {"PCM_16": (1, 16), "PCM_24": (1, 24), "PCM_32": (1, 32), "FLOAT": (3, 32), "DOUBLE": (3, 64)}[encoding]
    if tag == 3:
        body = np.ascontiguousarray(x, "<f4" if bits == 32 else "<f8").tobytes()
    else:
        full = 2.0 ** (bits - 1)
        whole = np.clip(np.floor(np.asarray(x, np.float64) * full), -full, full - 1).astype("<i8")
        body = {
            16: lambda: whole.astype("<i2").tobytes(),
            32: lambda: whole.astype("<i4").tobytes(),
            24: lambda: np.ascontiguousarray(whole.astype("<i4").reshape(-1, 1).view(np.uint8)[:, :3]).tobytes(),
        }[bits]()
    ch, align = x.shape[1], x.shape[1] * bits // 8
    head = b"WAVEfmt " + struct.pack(
        "<IHHIIHH",
        16,
        tag,
        ch,
        rate,
        rate * align,
        align,
        bits,
    ) + b"data" + struct.pack("<I", len(body))
    return b"RIFF" + struct.pack("<I", len(head) + len(body)) + head + body


def decoded(files: DataFrame) -> DataFrame:
    """path, signal_id (content hash), sr, ch, n, pcm, error; files: path, content. What can't be decoded gives an error."""

    names = ["path", "signal_id", "sr", "ch", "n", "pcm", "error"]
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.list_(pa.float32())), pa.string()]

    def named(held: list[tuple]) -> Iterator[tuple]:
        for (path, x, rate), name in zip(held, hashes([signal_bytes(x, rate) for _, x, rate in held])):
            yield path, name, rate, x.shape[1], len(x), [np.ascontiguousarray(x[:, c]) for c in range(x.shape[1])], None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Small signals are hashed together."""
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                path = batch.column(0)[i].as_py()
                try:
                    x, rate = decode(batch.column(1)[i].as_py())
                    signal_bytes(x[:0], rate)
                except (ValueError, struct.error, TypeError) as e:
                    yield path, None, None, None, None, None, f"decode_failed: {e}"
                    continue
                held.append((path, x, rate))
                size += x.nbytes
                if size > BATCH_BYTES or len(held) >= BATCH_ROWS:
                    yield from named(held)
                    held, size = [], 0
        yield from named(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(rows(batches), names, types)

    return files.select("path", "content").mapInArrow(
        run,
        "path string, signal_id string, sr int, ch int, n int, pcm array<array<float>>, error string",
    )


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", GLOB).load(path)
    return decoded(files.select("path", "content"))


def encoded(signals: DataFrame, encoding: str = "FLOAT") -> DataFrame:
    """signal_id, content: each signal as the bytes of a WAV file."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.stack([np.asarray(c.values) for c in batch.column(2)[i]], axis=1)
                yield batch.column(0)[i].as_py(), encode(x, batch.column(1)[i].as_py(), encoding)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(rows(batches), ["signal_id", "content"], [pa.string(), pa.binary()])

    return signals.select("signal_id", "sr", "pcm").mapInArrow(run, "signal_id string, content binary")


#: Bytes of a file in which its headers are looked for first.
HEAD = 64 << 10


def probed(files: DataFrame) -> DataFrame:
    """path, sr, ch, n, dur, encoding, without decoding. Only a file's head goes to Python, and its length; the whole file
    only where the head doesn't reach its samples. What can't be read has nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("sr", "ch", "n", "dur", "encoding")
        types = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.string())
        for batch in batches:
            found = []
            for raw, size in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                try:
                    found.append(probe(raw, size))
                except (ValueError, struct.error, TypeError):
                    found.append({})
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([f.get(n) for f in found], t) for n, t in zip(names, types))],
                ["path", *names],
            )

    schema = "path string, sr int, ch int, n bigint, dur double, encoding string"
    size = F.octet_length("content").cast("long").alias("size")
    heads = files.select("path", F.substring("content", 1, HEAD).alias("content"), size)
    first = materialize(heads.mapInArrow(run, schema), "probed")
    # Files that are longer and whose samples begin beyond the head, if they are WAV files at all.
    unread = broadcast_if_small(first.where("n is null").select("path"))
    late = files.where(
        (F.octet_length("content") > HEAD) & F.startswith("content", F.lit(b"RIFF"))
    ).join(unread, "path", "left_semi")
    again = materialize(late.select("path", "content", size).mapInArrow(run, schema), "probed")
    return first.join(broadcast_if_small(again.select("path")), "path", "left_anti").unionByName(again)
