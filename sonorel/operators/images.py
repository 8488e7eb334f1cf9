"""Pictures of signals as PNG bytes, and slices at onsets."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sonorel.operators import dsp as D
from sonorel.operators.arrow import in_batches
from sonorel.operators.features import decode_row

PICTURES = ("mel", "cqt", "hpss", "waveform")
LEAST = 2048


def png(grey: np.ndarray) -> bytes:
    """An 8-bit grey image, row by row from the top."""
    height, width = grey.shape
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    rows = np.concatenate([np.zeros((height, 1), np.uint8), grey.astype(np.uint8)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + part(
        b"IHDR",
        struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0),
    ) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def shaded(power: np.ndarray, below: float = 80.0) -> np.ndarray:
    """(frames, bins) as an image, low bins at the bottom, over 80 dB."""
    db = 10 * np.log10(np.maximum(power, 1e-10))
    return np.clip((db - db.max() + below) / below * 255, 0, 255).T[::-1]


def matrix(x: np.ndarray, rate: float, kind: str) -> np.ndarray:
    """The picture of one channel as shades from 0 to 255. Short signals are padded."""
    v = np.pad(x, (0, max(0, LEAST - len(x))))
    if kind == "waveform":
        columns = np.array_split(v, min(800, len(v)))
        top, low = np.array([c.max() for c in columns]), np.array([c.min() for c in columns])
        level = np.linspace(1, -1, 200)[:, None]
        return np.where((level <= top + 0.005) & (level >= low - 0.005), 255, 0)
    if kind == "hpss":
        hit = np.abs(D.spectrogram(D.percussive(v))) ** 2
        whole = np.abs(D.spectrogram(v)) ** 2
        return np.concatenate(
            [shaded(hit @ D.mel_bank(rate, 2048, 64).T), shaded(np.maximum(whole - hit, 0) @ D.mel_bank(rate, 2048, 64).T)]
        )
    power = np.abs(D.spectrogram(v)) ** 2
    if kind == "mel":
        return shaded(power @ D.mel_bank(rate, 2048, 128).T)
    if kind == "cqt":
        hz = np.fft.rfftfreq(2048, 1 / rate)
        centres = 32.7 * 2 ** (np.arange(84) / 12)
        nearest = np.exp(-0.5 * ((np.log2(np.maximum(hz, 1e-3))[None, :] - np.log2(centres)[:, None]) * 12 / 0.7) ** 2)
        return shaded(power @ (nearest / np.maximum(nearest.sum(axis=1, keepdims=True), 1e-12)).T)
    raise ValueError(f"no picture is named {kind}")


def pictures(signals: DataFrame, kinds: tuple[str, ...] = ("mel",)) -> DataFrame:
    """signal_id, kind, png."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, rate = decode_row(batch.column(2)[i]).mean(axis=1), float(batch.column(1)[i].as_py())
                for kind in kinds:
                    yield batch.column(0)[i].as_py(), kind, png(matrix(x, rate, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(rows(batches), ["signal_id", "kind", "png"], [pa.string(), pa.string(), pa.binary()])

    return signals.select("signal_id", "sr", "pcm").mapInArrow(run, "signal_id string, kind string, png binary")


def slices(signals: DataFrame, audio: bool = False) -> DataFrame:
    """signal_id, label (onset-i), sample, t, and with audio pcm: from each onset to the next, or the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, rate = decode_row(batch.column(2)[i]), float(batch.column(1)[i].as_py())
                at = D.onsets(x.mean(axis=1), rate).tolist()
                cut = [
                    [
                        x[a:b, c].astype(np.float32) for c in range(x.shape[1])
                    ] if audio else None for a, b in zip(at, [*at[1:], len(x)])
                ]
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[i].as_py()] * n),
                        pa.array([f"onset-{k}" for k in range(n)]),
                        pa.array(at, pa.int64()),
                        pa.array([round(a / rate, 6) for a in at]),
                        pa.array(cut, pa.list_(pa.list_(pa.float32()))),
                    ],
                    ["signal_id", "label", "sample", "t", "pcm"],
                )

    return signals.select("signal_id", "sr", "pcm").mapInArrow(
        run,
        "signal_id string, label string, sample bigint, t double, pcm array<array<float>>",
    )
