"""Measures of signals, as rows (signal_id, role, key, value), from one pass over each decoded signal.

describe() reads a table of schema.SIGNAL. Each family of measures is computed on
its own; one that fails gives an error row and leaves the others alone. Equal
signals are worth deduplicating by hash before, and joining back after.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sonorel.operators import dsp as D
from sonorel.schema import BANDS

Family = Callable[[np.ndarray, float], dict[str, float | None]]
SILENCE = 10 ** (-60 / 20)


def r(x: float | None, k: int) -> float | None:
    return None if x is None or not math.isfinite(x) else round(float(x), k)


def loudness(x: np.ndarray, rate: float) -> dict:
    return {
        "loudness.integrated_lufs": r(D.integrated(x, rate), 2),
        "loudness.true_peak_dbtp": r(D.true_peak(x)[0], 2),
        "loudness.max_short_term_lufs": r(D.short_term_max(x, rate), 2),
    }


def _over_time(name: str, v: np.ndarray) -> dict:
    v = v[np.isfinite(v)]
    return {
        f"lowlevel.spectral_{name}.mean": r(v.mean() if len(v) else 0.0, 6),
        f"lowlevel.spectral_{name}.stdev": r(v.std() if len(v) else 0.0, 6),
    }


def spectral(x: np.ndarray, rate: float, size: int = 2048, hop: int = 512) -> dict:
    """One transform, and from it every measure's mean and deviation over time."""
    m = np.abs(D.spectrogram(D.mono(x), size, hop))
    hz = np.fft.rfftfreq(size, 1 / rate)
    p = np.maximum(m**2, 1e-10)
    whole = np.maximum(m.sum(axis=1, keepdims=True), D.EPS)
    w = m / whole
    centre = (w * hz).sum(axis=1, keepdims=True)
    off = hz - centre
    spread = np.sqrt((w * off**2).sum(axis=1))
    wide = np.maximum(spread, D.EPS)
    roll = hz[np.minimum((np.cumsum(m, axis=1) < 0.85 * m.sum(axis=1, keepdims=True)).sum(axis=1), len(hz) - 1)]
    edges, contrast = [0.0, *(200.0 * 2.0**k for k in range(6)), rate / 2], []
    for lo, hi in zip(edges, edges[1:]):
        band = np.sort(m[:, (hz >= lo) & (hz <= hi)], axis=1)
        if band.shape[1]:
            k = max(1, round(0.02 * band.shape[1]))
            contrast.append(
                10 * np.log10(
                    np.maximum(band[:, -k:].mean(axis=1), 1e-10)
                ) - 10 * np.log10(np.maximum(band[:, :k].mean(axis=1), 1e-10))
            )
    slope = ((hz - hz.mean()) * (m - m.mean(axis=1, keepdims=True))).mean(axis=1) / hz.var()
    flat = 10 * np.log10(np.exp(np.log(p).mean(axis=1)) / p.mean(axis=1))
    return {
        **_over_time("flatness_db", flat),
        **_over_time("crest", m.max(axis=1) / np.maximum(m.mean(axis=1), D.EPS)),
        **_over_time("spread", spread),
        **_over_time("skewness", (w * off**3).sum(axis=1) / wide**3),
        **_over_time("kurtosis", (w * off**4).sum(axis=1) / wide**4),
        **_over_time("rolloff", roll),
        **_over_time("contrast", np.mean(contrast, axis=0)),
        **_over_time("slope", slope),
    }


def stereo_correlation(x: np.ndarray) -> float | None:
    if x.shape[1] < 2:
        return None
    a, b = x[:, 0] - x[:, 0].mean(), x[:, 1] - x[:, 1].mean()
    over = math.sqrt((a @ a) * (b @ b))
    return None if over <= D.EPS else max(-1.0, min(1.0, float(a @ b) / over))


def snr(x: np.ndarray, rate: float) -> float | None:
    size = max(256, int(0.02 * rate))
    v = D.mono(x)
    if len(v) < size:
        return None
    rms = np.sqrt((D.frames(v, size, max(1, size // 2), centred=False) ** 2).mean(axis=1))
    loud, low = np.percentile(rms, 90), np.percentile(rms, 5)
    noise = float(np.median(rms[rms <= low]))
    if loud <= 0:
        return None
    return 120.0 if noise <= 0 else min(120.0, 20 * math.log10(loud / noise))


def click_points(x: np.ndarray, rate: float, most: int = 64) -> list[int]:
    v = D.mono(x)
    d = np.abs(np.diff(v, 2))
    if not len(d):
        return []
    middle = np.median(d)
    found, last = [], -(10**9)
    for i in (np.flatnonzero((d > middle + 12 * np.median(np.abs(d - middle))) & (d > 0.05)) + 1).tolist():
        if i - last >= 0.005 * rate:
            found.append(i)
            last = i
    return found[:most]


def gap_runs(x: np.ndarray, rate: float, most: int = 64) -> list[tuple[int, int]]:
    """(start, samples) of silences of 10 ms or more with sound on both sides."""
    quiet = np.concatenate([[False], np.abs(x).max(axis=1, initial=0.0) < SILENCE, [False]]).astype(np.int8)
    starts, ends = np.flatnonzero(np.diff(quiet) == 1), np.flatnonzero(np.diff(quiet) == -1)
    return [(int(a), int(b - a)) for a, b in zip(starts, ends) if b - a >= 0.01 * rate and a > 0 and b < len(x)][:most]


def lossy_origin(x: np.ndarray, rate: float) -> dict:
    """Where the spectrum ends, and how much that looks like a codec's low pass: a steep edge with nothing above it."""
    size, v = 4096, D.mono(x)
    w = np.hanning(size)
    m = np.abs(np.fft.rfft(D.frames(v, size, size // 2, centred=False) * w, axis=1)).mean(axis=0)
    hz, nyquist = np.fft.rfftfreq(size, 1 / rate), rate / 2
    share = np.cumsum(m**2)
    out = {"qc.lossy.spectral_cutoff_hz": None, "qc.lossy.expected_nyquist_hz": r(nyquist, 1), "qc.lossy.confidence": 0.0}
    if share[-1] <= D.EPS:
        return out
    cutoff = float(hz[int(np.searchsorted(share, 0.999 * share[-1]))])
    confidence = 0.0
    if cutoff >= 10_000 and cutoff <= 0.95 * nyquist:
        level = lambda lo, hi: float(
            20 * np.log10(m[(hz >= lo) & (hz < hi)].mean() + 1e-12)
        ) if ((hz >= lo) & (hz < hi)).any() else -240.0
        third = 2 ** (1 / 3)
        drop = level(cutoff / third, cutoff) - level(cutoff, min(cutoff * third, nyquist))
        shelf = level(cutoff / third, cutoff) - level(cutoff * 1.03, nyquist)
        confidence = max(0.0, min(1.0, drop / 24)) * max(0.0, min(1.0, shelf / 60))
    return out | {"qc.lossy.spectral_cutoff_hz": r(cutoff, 1), "qc.lossy.confidence": r(confidence, 3)}


def qc(x: np.ndarray, rate: float) -> dict:
    peak = max([p for p in (D.true_peak(x)[0], D.to_db(float(np.abs(x).max(initial=0.0)))) if p is not None], default=None)
    out = {
        "qc.clipping.detected": float(peak is not None and peak >= -0.1),
        "qc.dc_offset_dbfs": r(D.to_db(float(np.abs(x.mean(axis=0)).max())) if len(x) else None, 2),
        "qc.snr_db": r(snr(x, rate), 1),
        **lossy_origin(x, rate),
    }
    c = stereo_correlation(x)
    return out if c is None else out | {"qc.phase.correlation": r(c, 4)}


def envelope_scalars(level: np.ndarray, rate: float, prefix: str) -> dict:
    """Attack, decay and sustain of one rise and fall."""
    floor = max(float(np.percentile(level, 5)), 1e-9)
    top = int(level.argmax())
    peak = max(float(level[top]), 1e-12)
    rise = level[: top + 1]
    first = lambda share: int(np.argmax(rise >= share * peak))
    attack = (first(0.9) - first(0.1)) * 1000 / rate
    after = level[top:]
    fell = np.flatnonzero(after <= peak / 10)
    early = after[: max(2, int(0.05 * rate))]
    t = np.arange(len(early)) * 1000 / rate
    slope = float(np.polyfit(t, 20 * np.log10(np.maximum(early, 1e-9)), 1)[0]) if len(early) > 1 else None
    late = after[min(len(after) - 1, int(0.15 * rate))]
    return {
        f"{prefix}.peak_db_over_floor": r(20 * math.log10(peak / floor), 3),
        f"{prefix}.attack_ms_10_90": r(attack, 3),
        f"{prefix}.rise_slope_db_ms": r(20 * math.log10(9) / attack if attack > 0 else None, 4),
        f"{prefix}.t20_ms": r(fell[0] * 1000 / rate if len(fell) else None, 3),
        f"{prefix}.early_decay_slope": r(slope, 4),
        f"{prefix}.sustain_ratio_150ms": r(float(late) / peak, 4),
    }


def _typical(level: np.ndarray, at: np.ndarray, rate: float) -> np.ndarray:
    """The median over onsets of the level from 10 ms before to the next onset, half a second at most."""
    gap = int(np.median(np.diff(at))) if len(at) > 1 else len(level)
    before, n = int(0.01 * rate), min(gap, int(0.5 * rate))
    rows = np.full((len(at), before + n), np.nan)
    for k, a in enumerate(at):
        lo, hi = max(0, a - before), min(len(level), a + n)
        rows[k, lo - (a - before) : hi - (a - before)] = level[lo:hi]
    with np.errstate(all="ignore"):
        return np.nan_to_num(np.nanmedian(rows, axis=0))


def envelope(x: np.ndarray, rate: float, mode: str = "auto", bpm: float | None = None) -> dict:
    v = D.mono(x)
    heard = np.flatnonzero(np.abs(v) > 10 ** (-60 / 20))
    if not len(heard):
        raise ValueError("nothing but silence")
    v = v[heard[0] :]
    at = D.onsets(v, rate, bpm)
    level = lambda s: D.follow(D.envelope_of(s), rate, 5, 20)
    if mode == "oneshot" or (mode == "auto" and len(at) < 2):
        return envelope_scalars(level(v), rate, "envelope")
    low = D.zero_phase(v[:, None], D.butterworth(4, 120.0, rate, "low"))[:, 0]
    return envelope_scalars(
        _typical(level(D.percussive(v)), at, rate),
        rate,
        "envelope.percussive",
    ) | envelope_scalars(_typical(level(low), at, rate), rate, "envelope.sub")


def _band(x: np.ndarray, rate: float, lo: float, hi: float, order: int = 4) -> np.ndarray:
    return D.zero_phase(x, D.butterworth(order, (lo, min(hi, 0.999 * rate / 2)), rate, "band"))


def width(x: np.ndarray, rate: float) -> dict:
    out = {}
    for name, lo, hi in BANDS:
        if x.shape[1] < 2 or lo >= 0.999 * rate / 2:
            correlation, ratio = 1.0, 0.0
        else:
            y = _band(x[:, :2], rate, lo, hi)
            over = math.sqrt((y[:, 0] @ y[:, 0]) * (y[:, 1] @ y[:, 1]))
            correlation = 1.0 if over <= D.EPS else float(y[:, 0] @ y[:, 1]) / over
            side, mid = (y[:, 0] - y[:, 1]) / 2, (y[:, 0] + y[:, 1]) / 2
            ratio = math.sqrt((side @ side) / max(mid @ mid, D.EPS))
        out |= {f"width.{name}.correlation": r(correlation, 4), f"width.{name}.side_mid_ratio": r(ratio, 4)}
    return out


def space(x: np.ndarray, rate: float) -> dict:
    channels, one = float((x * x).mean()) if len(x) else 0.0, float((D.mono(x) ** 2).mean()) if len(x) else 0.0
    loss = 0.0 if x.shape[1] < 2 or channels <= 1e-20 else 60.0 if one <= 1e-20 else max(
        0.0,
        min(60.0, 10 * math.log10(channels / one)),
    )
    return {"space.mono_collapse_penalty_db": r(loss, 3)}


def _rms_db(v: np.ndarray) -> np.ndarray:
    return 20 * np.log10(np.maximum(np.sqrt((D.frames(v, 2048, 512) ** 2).mean(axis=1)), 1e-9))


def _swing(db: np.ndarray) -> float:
    heard = db[db >= db.max() - 60]
    return float(np.percentile(heard, 90) - np.percentile(heard, 10))


def movement(x: np.ndarray, rate: float) -> dict:
    keys = ("sidechain_db", "bass_mod_depth_db", "hf_mod_depth_db", "hf_silence_pct", "tail_decay_200ms_db")
    if len(x) < rate:
        return {f"movement.{k}": None for k in keys}
    v = D.mono(x)
    high = D.zero_phase(v[:, None], D.butterworth(4, 6000.0, rate, "high"))[:, 0] if rate > 12_100 else np.zeros(len(v))
    bass, top = _band(v[:, None], rate, 60.0, 200.0)[:, 0], _rms_db(high)
    tail = v[-int(0.2 * rate) :]
    half = len(tail) // 2
    level = lambda s: 20 * math.log10(max(math.sqrt(float((s * s).mean())), 1e-9))
    values = (
        r(_swing(_rms_db(v)), 3),
        r(_swing(_rms_db(bass)), 3),
        r(_swing(top), 3),
        r(100.0 * float((top < top.max() - 60).mean()), 2),
        r(level(tail[:half]) - level(tail[half:]), 3),
    )
    return {f"movement.{k}": value for k, value in zip(keys, values)}


def clarity(x: np.ndarray, rate: float) -> dict:
    keys = (
        "low_mid_masking_db",
        "mud_presence_ratio",
        "band_contrast_lo_db",
        "band_contrast_hi_db",
        "presence_focus_ratio",
        "presence_transient_ratio",
    )
    if len(x) < 0.5 * rate:
        return {f"clarity.{k}": None for k in keys}
    p = np.abs(D.spectrogram(D.mono(x))) ** 2
    hz = np.fft.rfftfreq(2048, 1 / rate)
    inside = {n: (hz >= lo) & (hz < hi) for n, lo, hi in BANDS}
    mean = p.mean(axis=0)
    floor = max(float(mean.sum()) * 1e-6, D.EPS)
    power = {n: max(float(mean[k].sum()), floor) for n, k in inside.items()}

    def contrast(k: np.ndarray) -> float:
        own = mean[k]
        return 10 * math.log10(
            max(float(np.percentile(own, 85)), floor) / max(float(np.percentile(own, 15)), floor * 1e-3)
        ) if len(own) else 0.0

    over = p[:, inside["uppermid"]].sum(axis=1)
    values = (
        r(10 * math.log10(power["lomid"] / power["mid"]), 3),
        r(power["lomid"] / power["uppermid"], 4),
        r(contrast(inside["lomid"]), 3),
        r(contrast(inside["uppermid"]), 3),
        r(power["uppermid"] / power["full"], 5),
        r(math.sqrt(float(over.max()) / max(float(over.mean()), D.EPS)), 4),
    )
    return {f"clarity.{k}": value for k, value in zip(keys, values)}


def octaves(x: np.ndarray, rate: float, per_octave: int = 6) -> dict:
    """Levels of sixth-octave bins around 1 kHz and of the bands, against all power within them, no less than -120 dB."""
    hz, p = D.welch(D.mono(x), rate)
    top = min(20_000.0, 0.99 * rate / 2)
    low = math.ceil(per_octave * math.log2(20 / 1000))
    centres = [1000 * 2 ** (k / per_octave) for k in range(low, per_octave * 5 + 1) if 1000 * 2 ** (k / per_octave) <= top]
    whole = max(float(p[(hz >= 20) & (hz <= top)].sum()), D.EPS)
    step = 2 ** (1 / (2 * per_octave))
    level = lambda lo, hi: max(-120.0, 10 * math.log10(max(float(p[(hz >= lo) & (hz < hi)].sum()) / whole, 1e-12)))
    out = {f"spectrum.oct6.{round(c)}": r(level(c / step, c * step), 3) for c in centres}
    return out | {f"spectrum.band.{n}": r(level(lo, hi), 3) for n, lo, hi in BANDS if n != "full"}


def summary(x: np.ndarray, rate: float) -> dict:
    return {
        "dur_s": r(len(x) / rate, 4),
        "sr_hz": float(rate),
        "ch": float(x.shape[1]),
        "peak_dbfs": r(D.to_db(float(np.abs(x).max(initial=0.0))), 2),
        "rms_dbfs": r(D.to_db(math.sqrt(float((x * x).mean()))) if len(x) else None, 2),
    }


FAMILIES: dict[str, Family] = {
    "loudness": loudness,
    "spectral": spectral,
    "qc": qc,
    "envelope": envelope,
    "width": width,
    "movement": movement,
    "clarity": clarity,
    "space": space,
}
EXTRA: dict[str, Family] = {"octave-spectrum": octaves, "summary": summary}


def decode_row(pcm: pa.Scalar) -> np.ndarray:
    return np.stack([np.asarray(c.values, np.float64) for c in pcm], axis=1) if len(pcm) else np.zeros((0, 1))


def describe(signals: DataFrame, families: tuple[str, ...] = tuple(FAMILIES), rows_at_once: int = 16) -> DataFrame:
    """signal_id, family, key, value, error: every family of every signal. A family that fails gives its error, as code and message."""
    known = FAMILIES | EXTRA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows_at_once):
                out: list[list] = [[] for _ in range(5)]
                batch = whole.slice(at, rows_at_once)
                for i in range(batch.num_rows):
                    name, rate = batch.column(0)[i].as_py(), float(batch.column(1)[i].as_py())
                    try:
                        x, bad = decode_row(batch.column(2)[i]), None
                    except Exception as e:  # noqa: BLE001  a row that can't be decoded is data, not a failure of the job
                        x, bad = None, f"decode_failed: {e}"
                    for family in families:
                        try:
                            found, wrong = ({}, bad) if x is None else (known[family](x, rate), None)
                        except Exception as e:  # noqa: BLE001
                            found, wrong = {}, f"op_failed: {e}"
                        for key, value in ([(None, None)] if wrong else found.items()):
                            for column, v in zip(out, (name, family, key, value, wrong)):
                                column.append(v)
                types = [pa.string(), pa.string(), pa.string(), pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, types)],
                    ["signal_id", "family", "key", "value", "error"],
                )

    return signals.select("signal_id", "sr", "pcm").mapInArrow(
        run,
        "signal_id string, family string, key string, value double, error string",
    )


def markers(signals: DataFrame, over_db: float = -1.0) -> DataFrame:
    """signal_id, label, sample, t, dur: peaks over the ceiling, clicks and gaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                name, rate = batch.column(0)[i].as_py(), float(batch.column(1)[i].as_py())
                x = decode_row(batch.column(2)[i])
                rows += [(name, "over", s, round(s / rate, 6), None) for s in D.true_peak(x, over_db)[1]]
                rows += [(name, "click", s, round(s / rate, 6), None) for s in click_points(x, rate)]
                rows += [(name, "gap", s, round(s / rate, 6), round(n / rate, 6)) for s, n in gap_runs(x, rate)]
            types = [pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row[k] for row in rows], t) for k, t in enumerate(types)],
                ["signal_id", "label", "sample", "t", "dur"],
            )

    return signals.select("signal_id", "sr", "pcm").mapInArrow(
        run,
        "signal_id string, label string, sample bigint, t double, dur double",
    )
