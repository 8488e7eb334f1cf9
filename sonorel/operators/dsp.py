"""Signal primitives on numpy: filters, transforms, resampling, measures. Signals are (n, channels) float64."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

EPS = 1e-12


def to_db(x: float, per: float = 20.0) -> float | None:
    return per * math.log10(x) if x > 0 else None


def mono(x: np.ndarray) -> np.ndarray:
    return x.mean(axis=1)


# Recursive filters. A biquad runs over whole blocks by matrix products; only the two state values pass from block to block.

BLOCK = 256


@lru_cache(maxsize=256)
def _block_form(b: tuple, a: tuple) -> tuple[np.ndarray, ...]:
    """For a second-order section: response inside a block, what the state adds, and how the state moves on."""
    A = np.array([[-a[1], 1.0], [-a[2], 0.0]])
    B = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    powers = [np.eye(2)]
    for _ in range(BLOCK):
        powers.append(A @ powers[-1])
    observe = np.array([p[0] for p in powers[:BLOCK]])
    impulse = np.concatenate([[b[0]], observe[:-1] @ B])
    k = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
    inside = np.where(k >= 0, impulse[np.maximum(k, 0)], 0.0)
    drive = np.stack([powers[BLOCK - 1 - j] @ B for j in range(BLOCK)], axis=1)
    return inside, observe, powers[BLOCK], drive


def biquad(x: np.ndarray, b: tuple, a: tuple, state: np.ndarray | None = None) -> np.ndarray:
    n, ch = x.shape
    inside, observe, step, drive = _block_form(tuple(float(v) / a[0] for v in b), tuple(float(v) / a[0] for v in a))
    blocks = -(-n // BLOCK)
    padded = np.zeros((blocks * BLOCK, ch))
    padded[:n] = x
    cut = padded.reshape(blocks, BLOCK, ch)
    y = np.einsum("ij,bjc->bic", inside, cut, optimize=True)
    pushed = np.einsum("sj,bjc->bsc", drive, cut, optimize=True)
    s = np.zeros((2, ch)) if state is None else state
    for i in range(blocks):
        y[i] += observe @ s
        s = step @ s + pushed[i]
    return y.reshape(-1, ch)[:n]


def cascade(x: np.ndarray, sections: list[tuple[tuple, tuple]], settled: bool = False) -> np.ndarray:
    """settled: begins as if the first sample had always been there."""
    for b, a in sections:
        state = None
        if settled and len(x):
            gain = sum(b) / sum(a)
            state = np.outer([(gain * a[0] - b[0]) / a[0], (b[2] - gain * a[2]) / a[0]], x[0])
        x = biquad(x, b, a, state)
    return x


def zero_phase(x: np.ndarray, sections: list[tuple[tuple, tuple]]) -> np.ndarray:
    """Forwards and backwards, over an odd extension at either end."""
    pad = min(3 * (2 * len(sections) + 1), max(0, len(x) - 1))
    wide = np.concatenate([2 * x[:1] - x[pad:0:-1], x, 2 * x[-1:] - x[-2 : -pad - 2 : -1]]) if pad else x
    back = cascade(cascade(wide, sections, True)[::-1], sections, True)[::-1]
    return back[pad : pad + len(x)]


def butterworth(order: int, edges: float | tuple[float, float], rate: float, kind: str) -> list[tuple[tuple, tuple]]:
    """Second-order sections by the bilinear transform; kind: low, high or band. Edges are kept below Nyquist."""
    edges = np.atleast_1d(edges).astype(float)
    warped = 2 * rate * np.tan(math.pi * np.minimum(edges, 0.4995 * rate) / rate)
    poles = np.exp(1j * math.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    if kind == "low":
        poles, zeros = poles * warped[0], np.zeros(0)
    elif kind == "high":
        poles, zeros = warped[0] / poles, np.zeros(order)
    else:
        wide, centre = warped[1] - warped[0], math.sqrt(warped[0] * warped[1])
        half = poles * wide / 2
        root = np.sqrt(half**2 - centre**2)
        poles, zeros = np.concatenate([half + root, half - root]), np.zeros(order)
    digital = (2 * rate + poles) / (2 * rate - poles)
    ends = np.concatenate([(2 * rate + zeros) / (2 * rate - zeros), -np.ones(len(poles) - len(zeros))])
    at = {
        "low": 1.0,
        "high": -1.0,
        "band": np.exp(2j * math.atan(math.sqrt(np.prod(warped)) / (2 * rate))) if len(warped) > 1 else 1.0,
    }[kind]
    scale = 1 / abs(np.prod((at - ends) / (at - digital)))
    pairs = sorted(digital[digital.imag > 1e-14], key=abs)
    real = sorted(digital[abs(digital.imag) <= 1e-14].real)
    zs, out = sorted(ends.real), []
    groups = [(p, p.conjugate()) for p in pairs] + [tuple(real[i : i + 2]) for i in range(0, len(real), 2)]
    for k, group in enumerate(groups):
        own = [zs.pop(0), zs.pop()] if kind == "band" and len(zs) > 1 else [zs.pop() for _ in range(min(len(group), len(zs)))]
        b, a = np.real(np.poly(own)) if own else np.ones(1), np.real(np.poly(group))
        out.append((tuple(np.pad(b, (0, 3 - len(b))) * (scale if k == 0 else 1.0)), tuple(np.pad(a, (0, 3 - len(a))))))
    return out


def shelf_or_peak(kind: str, hz: float, gain_db: float, q: float, rate: float) -> tuple[tuple, tuple]:
    """Audio-EQ-cookbook sections."""
    A, w = 10 ** (gain_db / 40), 2 * math.pi * hz / rate
    alpha, c = math.sin(w) / (2 * q), math.cos(w)
    if kind == "peaking":
        return (1 + alpha * A, -2 * c, 1 - alpha * A), (1 + alpha / A, -2 * c, 1 - alpha / A)
    s = 2 * math.sqrt(A) * alpha
    sign = 1 if kind == "lowshelf" else -1
    b = (
        A * ((A + 1) - sign * (A - 1) * c + s),
        sign * 2 * A * ((A - 1) - sign * (A + 1) * c),
        A * ((A + 1) - sign * (A - 1) * c - s),
    )
    a = ((A + 1) + sign * (A - 1) * c + s, -sign * 2 * ((A - 1) + sign * (A + 1) * c), (A + 1) + sign * (A - 1) * c - s)
    return b, a


def resonant_low(hz: float, q: float, rate: float) -> tuple[tuple, tuple]:
    w = 2 * math.pi * min(hz, 0.49 * rate) / rate
    alpha, c = math.sin(w) / (2 * q), math.cos(w)
    return ((1 - c) / 2, 1 - c, (1 - c) / 2), (1 + alpha, -2 * c, 1 - alpha)


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Polyphase by a Kaiser-windowed sinc; ceil(n * up / down) samples."""
    g = math.gcd(up, down)
    up, down = up // g, down // g
    if up == down:
        return x.copy()
    half = 10 * max(up, down)
    t = np.arange(-half, half + 1)
    taps = np.sinc(t / max(up, down)) / max(up, down) * np.kaiser(2 * half + 1, 5.0)
    taps *= up / taps.sum()
    n = -(-len(x) * up // down)
    # Output m is a sum over the few inputs whose taps it meets: one row of taps for each phase.
    width = 2 * half // up + 1
    phases = np.zeros((up, width))
    index = np.arange(up)[:, None] + np.arange(width)[None, :] * up
    phases[index <= 2 * half] = taps[index[index <= 2 * half]]
    out = np.empty((n, x.shape[1]))
    padded = np.pad(x, ((width, width), (0, 0)))
    for at in range(0, n, 1 << 15):
        t = np.arange(at, min(n, at + (1 << 15))) * down + half
        rows = np.minimum(t // up, len(x) + width - 1)[:, None] - np.arange(width)[None, :] + width
        out[at : at + len(t)] = np.einsum("mk,mkc->mc", phases[t % up], padded[rows])
    return out


def convolve(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    n = len(x) + len(taps) - 1
    size = 1 << (n - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(taps, size), size)[:n]


def hann(n: int) -> np.ndarray:
    """Periodic."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def frames(x: np.ndarray, size: int, hop: int, centred: bool = True) -> np.ndarray:
    """(frames, size) of one channel; centred ones begin half a frame early, over zeros."""
    if centred:
        x = np.pad(x, size // 2)
    if len(x) < size:
        x = np.pad(x, (0, size - len(x)))
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def spectrogram(x: np.ndarray, size: int = 2048, hop: int = 512) -> np.ndarray:
    """Complex, (frames, bins)."""
    return np.fft.rfft(frames(x, size, hop) * hann(size), axis=1)


def welch(x: np.ndarray, rate: float, size: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and power density: Hann windows, half overlapping, without their means."""
    size = min(size, len(x))
    w = hann(size)
    cut = frames(x, size, max(1, size - size // 2), centred=False)
    p = np.abs(np.fft.rfft((cut - cut.mean(axis=1, keepdims=True)) * w, axis=1)) ** 2 / (rate * (w * w).sum())
    p[:, 1 : (-1 if size % 2 == 0 else None)] *= 2
    return np.fft.rfftfreq(size, 1 / rate), p.mean(axis=0)


def envelope_of(x: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal."""
    n = len(x)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0 and n:
        h[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x) * h))


def follow(level: np.ndarray, rate: float, attack_ms: float, release_ms: float) -> np.ndarray:
    """One-pole smoothing, quicker upwards."""
    up, down = math.exp(-1 / (rate * attack_ms / 1000)), math.exp(-1 / (rate * release_ms / 1000))
    out, y = np.empty(len(level)), 0.0
    for i, v in enumerate(level.tolist()):
        k = up if v > y else down
        y = v + k * (y - v)
        out[i] = y
    return out


def onsets(x: np.ndarray, rate: float, bpm: float | None = None, hop: int = 512) -> np.ndarray:
    """Sample numbers where spectral flux peaks, taken back to the energy minimum before; [0] where there are none."""
    power = np.abs(spectrogram(x, 2048, hop)) ** 2
    mel = power @ mel_bank(rate, 2048, 128).T
    loud = 10 * np.log10(np.maximum(mel, 1e-10))
    loud = np.maximum(loud, loud.max() - 80)
    flux = np.maximum(0, np.diff(loud, axis=0, prepend=loud[:1])).mean(axis=1)
    if flux.max() <= 0:
        return np.array([0])
    flux = flux / flux.max()
    per = rate / hop
    wait = max(1, int((60 / bpm / 8 if bpm else 0.03) * per))
    near, wide = max(1, int(0.03 * per)), max(1, int(0.1 * per))
    found, last = [], -(10**9)
    for i in range(len(flux)):
        a, b = max(0, i - near), i + 1
        if flux[i] == flux[a : b + near].max() and flux[i] >= flux[max(0, i - wide) : i + wide + 1].mean() + 0.07 and i - last > wait:
            found.append(i)
            last = i
    energy = np.sqrt((frames(x, 2048, hop) ** 2).mean(axis=1))
    out = []
    for i in found:
        while i > 0 and energy[i - 1] < energy[i]:
            i -= 1
        out.append(i * hop)
    return np.unique(out) if out else np.array([0])


@lru_cache(maxsize=8)
def mel_bank(rate: float, size: int, bands: int) -> np.ndarray:
    """Triangles, equally spaced on the mel scale, of equal area."""
    to_mel = lambda f: 2595 * np.log10(1 + np.asarray(f) / 700)
    edges = 700 * (10 ** (np.linspace(to_mel(0.0), to_mel(rate / 2), bands + 2) / 2595) - 1)
    hz = np.fft.rfftfreq(size, 1 / rate)
    rise = (hz[None, :] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    fall = (edges[2:, None] - hz[None, :]) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def percussive(x: np.ndarray, width: int = 31) -> np.ndarray:
    """What median filters along frequency keep more of than those along time."""
    z = spectrogram(x)
    mag = np.abs(z)
    along = lambda m, axis: np.median(
        np.lib.stride_tricks.sliding_window_view(
            np.pad(
                m,
                [(width // 2,) * 2 if k == axis else (0, 0) for k in (0, 1)],
                mode="reflect" if m.shape[axis] > width // 2 else "edge",
            ),
            width,
            axis=axis,
        ),
        axis=-1,
    )
    hit, tone = along(mag, 1) ** 2, along(mag, 0) ** 2
    return overlap_add(z * hit / np.maximum(hit + tone, EPS), 2048, 512, len(x))


def overlap_add(z: np.ndarray, size: int, hop: int, n: int) -> np.ndarray:
    w = hann(size)
    out, weight = np.zeros(size + hop * (len(z) - 1)), np.zeros(size + hop * (len(z) - 1))
    for i, frame in enumerate(np.fft.irfft(z, size, axis=1)):
        out[i * hop : i * hop + size] += frame * w
        weight[i * hop : i * hop + size] += w * w
    out = out / np.maximum(weight, 1e-8)
    out = out[size // 2 :]
    return out[:n] if len(out) >= n else np.pad(out, (0, n - len(out)))


def stretched(x: np.ndarray, speed: float, size: int = 2048, hop: int = 512) -> np.ndarray:
    """Phase vocoder on one channel: 1 / speed times as long."""
    z = spectrogram(x, size, hop)
    at = np.arange(0, len(z), speed)
    step = 2 * np.pi * hop * np.arange(z.shape[1]) / size
    z = np.concatenate([z, np.zeros((2, z.shape[1]))])
    i = at.astype(int)
    w = (at - i)[:, None]
    mag = (1 - w) * np.abs(z[i]) + w * np.abs(z[i + 1])
    turn = np.angle(z[i + 1]) - np.angle(z[i]) - step
    turn = step + turn - 2 * np.pi * np.round(turn / (2 * np.pi))
    phase = np.angle(z[0]) + np.concatenate([np.zeros((1, z.shape[1])), np.cumsum(turn, axis=0)[:-1]])
    return overlap_add(mag * np.exp(1j * phase), size, hop, int(round(len(x) / speed)))


# Loudness.


def k_weighting(rate: float) -> list[tuple[tuple, tuple]]:
    """The head shelf and the high pass of BS.1770 at any rate."""
    shelf = shelf_or_peak("highshelf", 1500.0, 4.0, 1 / math.sqrt(2), rate)
    w = 2 * math.pi * 38.0 / rate
    alpha, c = math.sin(w) / (2 * 0.5), math.cos(w)
    return [shelf, (((1 + c) / 2, -(1 + c), (1 + c) / 2), (1 + alpha, -2 * c, 1 - alpha))]


def _block_power(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    total = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x * x, axis=0)])
    starts = np.arange(0, len(x) - size + 1, hop)
    weights = np.array([1.0, 1.0, 1.0, 1.41, 1.41][: x.shape[1]] + [1.0] * max(0, x.shape[1] - 5))
    return ((total[starts + size] - total[starts]) / size) @ weights


def integrated(x: np.ndarray, rate: float) -> float | None:
    """LUFS; None where the signal is too short or silent."""
    size = round(0.4 * rate)
    if len(x) < size + 1:
        return None
    p = _block_power(cascade(x, k_weighting(rate)), size, max(1, round(0.1 * rate)))
    loud = lambda v: -0.691 + 10 * np.log10(np.maximum(v, 1e-30))
    p = p[loud(p) > -70]
    if not len(p):
        return None
    p = p[loud(p) > loud(p.mean()) - 10]
    return float(loud(p.mean())) if len(p) else None


def short_term_max(x: np.ndarray, rate: float) -> float | None:
    size = int(3 * rate)
    if len(x) < size:
        return None
    found = [v for a in range(0, len(x) - size + 1, int(rate)) if (v := integrated(x[a : a + size], rate)) is not None]
    return max(found, default=None)


def true_peak(x: np.ndarray, over_db: float | None = None) -> tuple[float | None, list[int]]:
    """Peak in dB after fourfold oversampling, and the samples near which it passes over_db."""
    if not len(x):
        return None, []
    big = np.abs(resample(x, 4, 1)).max(axis=1)
    over = [] if over_db is None else np.unique(np.flatnonzero(big > 10 ** (over_db / 20)) // 4).tolist()
    return to_db(float(big.max())), over
