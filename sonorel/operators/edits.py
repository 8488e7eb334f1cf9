"""Signals to signals. Each edit is (signal, rate) -> signal; edited() applies one to a table of signals."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonorel.operators import dsp as D
from sonorel.operators.arrow import in_batches
from sonorel.operators.features import decode_row

Edit = Callable[..., np.ndarray]


def clip(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -1.0, 1.0)


def gain(x: np.ndarray, rate: float, db: float) -> np.ndarray:
    return x * 10 ** (db / 20)


def normalize(x: np.ndarray, rate: float, lufs: float, ceiling: float | None = -1.0) -> np.ndarray:
    """To a loudness, held back so that the true peak stays under the ceiling; silence stays."""
    now = D.integrated(x, rate)
    if now is None:
        return x
    db = lufs - now
    peak = D.true_peak(x)[0]
    return gain(x, rate, db if ceiling is None or peak is None else min(db, ceiling - peak))


def limit(x: np.ndarray, rate: float, ceiling: float = -1.0) -> np.ndarray:
    peak = D.true_peak(x)[0]
    return x if peak is None else gain(x, rate, min(0.0, ceiling - peak))


def compress(
    x: np.ndarray,
    rate: float,
    threshold: float = -18.0,
    ratio: float = 3.0,
    attack: float = 10.0,
    release: float = 120.0,
    knee: float = 6.0,
    makeup: float = 0.0,
) -> np.ndarray:
    """The channels share one detector; the curve bends over the knee."""
    k = math.exp(-1 / (rate * 0.005))
    power = D.cascade((np.abs(x).max(axis=1) ** 2)[:, None], [((1 - k, 0.0, 0.0), (1.0, -k, 0.0))])[:, 0]
    over = 10 * np.log10(np.maximum(power, 1e-12)) - threshold
    slope = 1 / ratio - 1
    curve = np.where(
        over <= -knee / 2,
        0.0,
        np.where(over >= knee / 2, slope * over, slope * (over + knee / 2) ** 2 / (2 * max(knee, 1e-9))),
    )
    return clip(x * 10 ** ((makeup - D.follow(-curve, rate, attack, release)) / 20)[:, None])


def maximize(
    x: np.ndarray,
    rate: float,
    ceiling: float = -1.0,
    makeup: float = 6.0,
    lookahead: float = 2.0,
    release: float = 60.0,
) -> np.ndarray:
    """Driven up, then held under the ceiling by a gain that falls ahead of peaks and rises at a fixed rate."""
    x = gain(x, rate, makeup)
    top, n = 10 ** (ceiling / 20), max(1, int(lookahead * rate / 1000))
    need = np.minimum(1.0, top / np.maximum(np.abs(x).max(axis=1), 1e-12))
    least = np.lib.stride_tricks.sliding_window_view(
        np.concatenate([need, need[::-1][: n - 1] if n > 1 else need[:0]]),
        n,
    ).min(axis=1)[: len(need)]
    step, g, out = 1 / max(1.0, release * rate / 1000), 1.0, np.empty(len(least))
    for i, v in enumerate(least.tolist()):
        g = v if v < g else min(v, g + step)
        out[i] = g
    return np.clip(x * out[:, None], -top, top)


def filtered(
    x: np.ndarray,
    rate: float,
    hp: float | None = None,
    lp: float | None = None,
    bp: tuple[float, float] | None = None,
    order: int = 4,
) -> np.ndarray:
    for kind, edge in (("high", hp), ("low", lp), ("band", bp)):
        if edge is not None:
            x = D.zero_phase(x, D.butterworth(order, edge, rate, kind))
    return clip(x)


def equalize(x: np.ndarray, rate: float, bands: list[tuple[str, float, float, float]]) -> np.ndarray:
    """bands: (peaking, lowshelf or highshelf; Hz; dB; Q), one after another."""
    return clip(D.cascade(x, [D.shelf_or_peak(kind, hz, db, q, rate) for kind, hz, db, q in bands]))


def shape(
    x: np.ndarray,
    rate: float,
    kind: str,
    attack: float = 0.0,
    release: float = 0.0,
    threshold_db: float = -40.0,
) -> np.ndarray:
    """pluck: linear rise, exponential fall; fade: linear at both ends; gate: silence under a 10 ms level."""
    n, i = len(x), np.arange(len(x))
    a, b = round(attack * rate), round(release * rate)
    if kind == "gate":
        size = max(1, int(0.01 * rate))
        level = np.convolve((x * x).mean(axis=1), np.ones(size) / size, "same")
        return np.where((level >= 10 ** (threshold_db / 10))[:, None], x, 0.0)
    rise = np.minimum(1.0, i / a) if a else np.ones(n)
    fall = np.exp(-np.maximum(0, i - a) / max(1, b)) if kind == "pluck" else np.minimum(1.0, (n - 1 - i) / b) if b else np.ones(n)
    return x * (rise * fall)[:, None]


# Levels of an echo's input and output.
ECHO_IN, ECHO_OUT = 0.8, 0.9


def delay(x: np.ndarray, rate: float, ms: float = 250.0, decay: float = 0.5) -> np.ndarray:
    """One echo; what sounds after the end stays."""
    n = round(ms * rate / 1000)
    out = np.pad(ECHO_IN * x, ((0, n), (0, 0)))
    out[n:] += decay * x
    return clip(ECHO_OUT * out)


#: Seconds of the loops that build up a room's sound, and of those that spread its echoes.
ROOM_LOOPS, ROOM_SPREAD = (0.0253, 0.0269, 0.0290, 0.0307, 0.0322, 0.0338, 0.0353, 0.0367), (0.0126, 0.0100, 0.0077, 0.0051)


def _loop(x: np.ndarray, n: int, back: float, pure: bool) -> np.ndarray:
    """Feedback after n samples: what comes back is added, or, pure, all frequencies keep their level. n samples are worked on at once, as none depends on another."""
    x = np.pad(x, (0, -len(x) % n)).reshape(-1, n)
    held, out = np.zeros(n), np.empty_like(x)
    for k, part in enumerate(x):
        if pure:
            out[k] = held - back * part
            held = part + back * out[k]
        else:
            out[k] = held
            held = part + back * held
    return out.ravel()


def reverb(x: np.ndarray, rate: float, amount: float = 50.0, seconds: float = 1.0) -> np.ndarray:
    """A room: parallel loops, then spreading ones, mixed in by half. amount (0 to 100) is how long it rings."""
    back = 0.7 + 0.28 * min(100.0, max(0.0, amount)) / 100
    long = np.pad(x, ((0, round(seconds * rate)), (0, 0)))

    def room(v: np.ndarray) -> np.ndarray:
        wet = sum(_loop(v, max(1, round(s * rate)), back, False)[: len(v)] for s in ROOM_LOOPS) / len(ROOM_LOOPS)
        for s in ROOM_SPREAD:
            wet = _loop(wet, max(1, round(s * rate)), 0.5, True)[: len(v)]
        return wet

    return clip(long + 0.5 * _each(long, room))


def crop(x: np.ndarray, rate: float, start: float = 0.0, end: float | None = None) -> np.ndarray:
    return x[max(0, round(start * rate)) : len(x) if end is None else min(len(x), round(end * rate))]


def reverse(x: np.ndarray, rate: float) -> np.ndarray:
    return x[::-1]


def _each(x: np.ndarray, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    return np.stack([f(x[:, c]) for c in range(x.shape[1])], axis=1)


def stretch(x: np.ndarray, rate: float, ratio: float) -> np.ndarray:
    """ratio times as long, at the same pitch."""
    if ratio <= 0:
        raise ValueError("ratio must be positive")
    return _each(x, lambda v: D.stretched(v, 1 / ratio))


def pitch(x: np.ndarray, rate: float, semitones: float) -> np.ndarray:
    shift = 2 ** (semitones / 12)
    y = D.resample(stretch(x, rate, shift), 1000, round(1000 * shift))[: len(x)]
    return np.pad(y, ((0, len(x) - len(y)), (0, 0)))


def widen(x: np.ndarray, rate: float, side_gain_db: float = 3.0, crossover: float = 200.0, order: int = 4) -> np.ndarray:
    """More of the side above the crossover; mono stays."""
    if x.shape[1] != 2 or len(x) < 64:
        return x
    mid, side = x.mean(axis=1), (x[:, 0] - x[:, 1]) / 2
    high = D.zero_phase(side[:, None], D.butterworth(order, crossover, rate, "high"))[:, 0]
    side = side + high * (10 ** (side_gain_db / 20) - 1)
    return clip(np.stack([mid + side, mid - side], axis=1))


def stereoize(x: np.ndarray, rate: float, amount: float = 0.4, crossover: float = 200.0, order: int = 4) -> np.ndarray:
    """A decorrelated copy of the middle's highs goes to the side; the sum of the channels stays as it was."""
    left, right = x[:, 0], x[:, -1]
    mid, side = (left + right) / 2, (left - right) / 2
    y = D.zero_phase(mid[:, None], D.butterworth(order, crossover, rate, "high")) if len(x) > 64 else mid[:, None]
    for hz in (400.0, 900.0, 2100.0, 4700.0):
        t = math.tan(math.pi * min(hz, 0.45 * rate) / rate)
        c = (t - 1) / (t + 1)
        y = D.biquad(y, (c, 1.0, 0.0), (1.0, c, 0.0))
    side = side + amount * y[:, 0]
    return np.stack([mid + side, mid - side], axis=1)


def curve(
    n: int,
    rate: float,
    shape: str = "sine",
    cycles: float = 1.0,
    depth: float = 1.0,
    phase: float = 0.0,
    duty: float = 0.5,
    points: list[tuple[float, float]] | None = None,
) -> np.ndarray:
    """0..1 over the signal."""
    if shape == "points":
        at, v = zip(*sorted(points or [(0.0, 1.0)]))
        return np.interp(np.linspace(0, 1, n), at, v)
    t = (np.arange(n) * cycles / max(1, n) + phase) % 1.0
    wave = {
        "sine": 0.5 + 0.5 * np.sin(2 * np.pi * t),
        "tri": 1 - np.abs(2 * t - 1),
        "saw-up": t,
        "saw-down": 1 - t,
        "square": (t < duty).astype(float),
    }[shape]
    return 1 - depth + depth * wave


def automate(
    x: np.ndarray,
    rate: float,
    target: str,
    lo: float = 200.0,
    hi: float = 8000.0,
    resonance: float = 0.707,
    hop: int = 128,
    **how,
) -> np.ndarray:
    """Gain, pan (constant power) or the cutoff of a resonant low pass, along a curve."""
    m = curve(len(x), rate, **how)
    if target == "gain":
        return clip(x * m[:, None])
    if target == "pan":
        v, angle = D.mono(x), m * math.pi / 2
        return clip(np.stack([v * np.cos(angle), v * np.sin(angle)], axis=1) * math.sqrt(2))
    out, state = np.empty_like(x), np.zeros((2, x.shape[1]))
    for a in range(0, len(x), hop):
        b_, a_ = D.resonant_low(lo * (hi / lo) ** m[a], resonance, rate)
        b, c = [v / a_[0] for v in b_], [v / a_[0] for v in a_]
        for i in range(a, min(a + hop, len(x))):
            y = b[0] * x[i] + state[0]
            state[0] = b[1] * x[i] - c[1] * y + state[1]
            state[1] = b[2] * x[i] - c[2] * y
            out[i] = y
    return clip(out)


def spectral_match(
    x: np.ndarray,
    rate: float,
    reference: np.ndarray,
    strength: float = 1.0,
    most: float = 6.0,
    bands: int = 12,
    lo: float = 30.0,
    hi: float = 16_000.0,
    protect_below: float = 60.0,
) -> np.ndarray:
    """Peaking filters that bring the shape of the spectrum towards the reference's, within `most` dB."""
    edges = np.geomspace(lo, min(hi, 0.45 * rate), bands + 1)

    def shape_of(v: np.ndarray) -> np.ndarray:
        f, p = D.welch(D.mono(v), rate)
        level = np.array(
            [10 * math.log10(max(float(p[(f >= a) & (f < b)].mean()) if ((f >= a) & (f < b)).any() else 0.0, 1e-12)) for a, b in zip(edges, edges[1:])]
        )
        return level - level.mean()

    deltas = np.clip(strength * (shape_of(reference) - shape_of(x)), -most, most)
    centres = np.sqrt(edges[1:] * edges[:-1])
    return clip(
        D.cascade(
            x,
            [D.shelf_or_peak("peaking", c, d, 1.4, rate) for c, d in zip(centres, deltas) if c >= protect_below and abs(d) > 0.01],
        )
    )


def vocode(
    carrier: np.ndarray,
    rate: float,
    modulator: np.ndarray,
    modulator_rate: float | None = None,
    bands: int = 24,
    lo: float = 70.0,
    hi: float = 11_000.0,
    ess: float = 5500.0,
    ess_mix: float = 0.35,
    attack: float = 2.0,
    release: float = 45.0,
) -> np.ndarray:
    """The carrier's bands take the modulator's levels; the modulator's hiss is mixed in on top."""
    if modulator_rate and modulator_rate != rate:
        modulator = D.resample(modulator, int(rate), int(modulator_rate))
    n = min(len(carrier), len(modulator))
    c, m = D.mono(carrier[:n])[:, None], D.mono(modulator[:n])[:, None]
    edges, body = np.geomspace(lo, min(hi, 0.45 * rate), bands + 1), np.zeros(n)
    for a, b in zip(edges, edges[1:]):
        sections = D.butterworth(2, (a, b), rate, "band")
        level = D.follow(np.abs(D.cascade(m, sections))[:, 0], rate, attack, release)
        body += D.cascade(c, sections)[:, 0] * level
    body *= 0.9 / max(float(np.abs(body).max()), 1e-9)
    hiss = D.cascade(m, D.butterworth(4, min(ess, 0.45 * rate), rate, "high"))[:, 0]
    return np.clip(body + ess_mix * hiss, -0.98, 0.98)[:, None]


def convert(x: np.ndarray, rate: float, sr: int | None = None, bits: int | None = None) -> np.ndarray:
    if sr and sr != rate:
        x = D.resample(x, sr, int(rate))
    if bits in (16, 24):
        full = 2.0 ** (bits - 1)
        x = np.clip(np.round(x * full), -full, full - 1) / full
    return x


def generate(prompt: str, seed: int = 0, duration: float = 2.0, rate: int = 44_100) -> np.ndarray:
    """A chord with a pulse, whose colour follows words of the prompt: the same for the same prompt and seed."""
    rng = np.random.default_rng([seed, *prompt.encode()])
    t = np.arange(int(duration * rate)) / rate
    base = 55.0 * 2 ** (rng.integers(0, 24) / 12)
    rolloff = 2.0 if any(
        w in prompt.lower() for w in ("dark", "warm", "bass", "sub")
    ) else 0.7 if any(w in prompt.lower() for w in ("bright", "sharp", "air")) else 1.2
    x = sum(
        np.sin(
            2 * np.pi * base * k * h * t + rng.random() * 2 * np.pi
        ) / h**rolloff for k in (1.0, 1.25, 1.5) for h in range(1, 7)
    )
    x = x * np.exp(-4 * (t % 0.5))
    return (x / max(float(np.abs(x).max(initial=0.0)), 1e-9) * 10 ** (-1 / 20))[:, None]


EDITS: dict[str, Edit] = {
    "gain": gain,
    "normalize": normalize,
    "limit": limit,
    "compress": compress,
    "maximize": maximize,
    "filter": filtered,
    "eq": equalize,
    "env": shape,
    "delay": delay,
    "reverb": reverb,
    "crop": crop,
    "reverse": reverse,
    "stretch": stretch,
    "pitch": pitch,
    "widen": widen,
    "stereoize": stereoize,
    "automate": automate,
    "convert": convert,
}
SIGNAL = "signal_id string, sr int, ch int, n int, pcm array<array<float>>, error string"
SIGNAL_NAMES = ["signal_id", "sr", "ch", "n", "pcm", "error"]
SIGNAL_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.list_(pa.float32())), pa.string()]


def edited(signals: DataFrame, name: str, **how) -> DataFrame:
    """Every signal edited; one that can't be gives its error and no samples."""
    edit, rate_after = EDITS[name], how.get("sr") if name == "convert" else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for whole in batches:
            for i in range(whole.num_rows):
                name_, rate = whole.column(0)[i].as_py(), whole.column(1)[i].as_py()
                try:
                    y, bad = edit(decode_row(whole.column(2)[i]), float(rate), **how), None
                except Exception as e:  # noqa: BLE001  one bad row is data, not a failure of the job
                    y, bad = np.zeros((0, 1)), f"op_failed: {e}"
                yield name_, rate_after or rate, y.shape[1], len(y), [y[:, c].astype(np.float32) for c in range(y.shape[1])], bad

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(rows(batches), SIGNAL_NAMES, SIGNAL_TYPES)

    return signals.select("signal_id", "sr", "pcm").mapInArrow(run, SIGNAL)


PAIRED: dict[str, Callable[..., np.ndarray]] = {"vocode": vocode, "spectral-match": spectral_match}


def paired(signals: DataFrame, others: DataFrame, name: str, **how) -> DataFrame:
    """schema.SIGNAL, error and lineage (both parents' ids): each signal edited by another. signals: pair, and a signal;
    others: the carrier's modulator or the source's reference under the same pair. Pairs whose rates differ are
    resampled to the first's; a pair that can't be edited gives its error and no samples. Each of two tables is shuffled
    by pair once, and a task holds one pair at a time."""
    edit = PAIRED[name]
    sides = [
        s.select(
            "pair",
            *[F.col(c).alias(f"{c}{k}") for c in ("signal_id", "sr", "pcm")],
        ) for k, s in enumerate((signals, others))
    ]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for whole in batches:
            for i in range(whole.num_rows):
                value = {n: whole.column(n)[i] for n in whole.schema.names}
                ids, rate = [value[f"signal_id{k}"].as_py() for k in (0, 1)], value["sr0"].as_py()
                try:
                    x, other = decode_row(value["pcm0"]), decode_row(value["pcm1"])
                    if value["sr1"].as_py() != rate:
                        other = D.resample(other, rate, value["sr1"].as_py())
                    y, bad = edit(x, float(rate), other, **how), None
                except Exception as e:  # noqa: BLE001  one bad pair is data, not a failure of the job
                    y, bad = np.zeros((0, 1)), f"op_failed: {e}"
                yield f"{name}:{ids[0]}", rate, y.shape[1], len(y), [
                    y[:, c].astype(np.float32) for c in range(y.shape[1])
                ], bad, ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(rows(batches), [*SIGNAL_NAMES, "lineage"], [*SIGNAL_TYPES, pa.list_(pa.string())])

    return sides[0].join(sides[1], "pair").drop("pair").mapInArrow(run, SIGNAL + ", lineage array<string>")
