"""Sets of word shingles, hashed to 64 bits, for whole batches of texts at once."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

WORDS = 5
#: Bytes of text that are worked on at a time.
STRETCH = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_POWERS: list[np.ndarray] = []
_STEPS = np.array([pow(_BASE, 2 * k + 3, 1 << 64) for k in range(WORDS)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [
            np.cumprod(
                np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]),
                dtype=np.uint64,
            ) for b in (_BASE & _MASK, pow(_BASE, -1, 1 << 64))
        ]
    return [x[:n] for x in _POWERS]


def _word_hashes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word."""
    raw = np.frombuffer(blob, np.uint8)
    edge = np.diff(np.concatenate([[False], ~_SPACE[raw], [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(raw))
    total = np.concatenate([[np.uint64(0)], np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
    return mix(
        (total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    ), starts


def _long_word_hashes(raw: bytes) -> np.ndarray:
    """Of one long text, in stretches that end at a space, so that memory stays bounded by the longest word."""
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + STRETCH)
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        out.append(_word_hashes(raw[at:end])[0])
        at = end
    return np.concatenate(out)


def _set(words: np.ndarray) -> np.ndarray:
    n = len(words)
    if n >= WORDS:
        parts = np.zeros(n - WORDS + 1, np.uint64)
        for k in range(WORDS):
            parts += words[k : k + len(parts)] * _STEPS[k]
        return np.unique(mix(parts))
    return mix((words * _STEPS[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)) if n else np.zeros(0, np.uint64)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles: A-Z lower-cased, words cut at ASCII space, five
    words each; the whole sequence where there are fewer; nothing without words."""
    raws = [(t or "").encode("utf-8") for t in texts]
    out: list[np.ndarray] = []
    at = 0
    while at < len(raws):
        # Short texts go together, as many as fill a stretch.
        end, size = at, 0
        while end < len(raws) and size + len(raws[end]) < STRETCH:
            size += len(raws[end]) + 1
            end += 1
        if end == at:
            out.append(_set(_long_word_hashes(raws[at])))
            at += 1
            continue
        own = raws[at:end]
        words, starts = _word_hashes(b"\n".join(own) + b"\n")
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(r) + 1 for r in own])).tolist()
        out += [_set(words[a:b]) for a, b in zip(bounds, bounds[1:])]
        at = end
    return out


def digest(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.tobytes(), digest_size=16).digest()
