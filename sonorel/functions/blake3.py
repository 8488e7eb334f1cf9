"""BLAKE3 on numpy: the chunks of an input are compressed side by side."""

from __future__ import annotations

import numpy as np

# Fixed values of the published function.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
_MIXES = (
    (0, 4, 8, 12),
    (1, 5, 9, 13),
    (2, 6, 10, 14),
    (3, 7, 11, 15),
    (0, 5, 10, 15),
    (1, 6, 11, 12),
    (2, 7, 8, 13),
    (3, 4, 9, 14),
)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(cv: np.ndarray, block: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """(k, 8) new chaining values of k blocks of 16 words."""
    k = len(block)
    iv = np.array(IV[:4], np.uint32)
    v = [cv[:, i] for i in range(8)] + [np.full(k, iv[i]) for i in range(4)] + [
        (counter & 0xFFFFFFFF).astype(np.uint32),
        (counter >> 32).astype(np.uint32),
        length.astype(np.uint32),
        flags.astype(np.uint32),
    ]
    m = [block[:, i] for i in range(16)]
    for _ in range(7):
        for j, (a, b, c, d) in enumerate(_MIXES):
            for word, r1, r2 in ((m[2 * j], 16, 12), (m[2 * j + 1], 8, 7)):
                v[a] = v[a] + v[b] + word
                v[d] = _turn(v[d] ^ v[a], r1)
                v[c] = v[c] + v[d]
                v[b] = _turn(v[b] ^ v[c], r2)
        m = [m[i] for i in ORDER]
    return np.stack([v[i] ^ v[i + 8] for i in range(8)], axis=1)


#: Bytes of inputs that are worked on together.
TOGETHER = 16 << 20


def blake3(data: bytes) -> str:
    """Hexadecimal digest of 32 bytes."""
    return blake3_many([data])[0]


def blake3_many(inputs: list[bytes]) -> list[str]:
    """The digest of each input; as many as fit TOGETHER go side by side, so many small ones cost little more than one."""
    out, own, size = [], [], 0
    for data in inputs:
        if own and size + len(data) > TOGETHER:
            out += _together(own)
            own, size = [], 0
        own.append(data)
        size += max(1024, len(data))
    return out + (_together(own) if own else [])


def _together(inputs: list[bytes]) -> list[str]:
    lengths = np.array([len(x) for x in inputs])
    chunks = np.maximum(1, -(-lengths // 1024))
    first = np.concatenate([[0], np.cumsum(chunks)])
    padded = np.zeros(int(first[-1]) * 1024, np.uint8)
    for data, at in zip(inputs, first.tolist()):
        padded[at * 1024 : at * 1024 + len(data)] = np.frombuffer(data, np.uint8)
    words = padded.view("<u4").reshape(-1, 16, 16)
    owner = np.repeat(np.arange(len(inputs)), chunks)
    number = np.arange(len(owner)) - first[owner]
    size = np.minimum(1024, lengths[owner] - 1024 * number)
    alone = np.where(chunks[owner] == 1, ROOT, 0)
    blocks = np.maximum(1, -(-size // 64))
    cv = np.tile(np.array(IV, np.uint32), (len(owner), 1))
    for b in range(int(blocks.max())):
        on = np.flatnonzero(blocks > b)
        flags = np.where(blocks[on] == b + 1, CHUNK_END | alone[on], 0) | (CHUNK_START if b == 0 else 0)
        cv[on] = compress(cv[on], words[on, b], number[on].astype(np.uint64), np.minimum(64, size[on] - 64 * b), flags)
    cv = _joined(cv, owner, chunks)
    return [row.tobytes().hex() for row in cv.astype("<u4")]


def _joined(cv: np.ndarray, owner: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The value over each input's chunks. Neighbours are joined, level by level, for all inputs at once; one that has
    none waits, which gives the tree whose left parts are the largest powers of two."""
    while len(cv) > len(count):
        first = np.concatenate([[0], np.cumsum(count)])
        place = np.arange(len(cv)) - first[owner]
        left = np.flatnonzero((place % 2 == 0) & (place + 1 < count[owner]))
        both = np.concatenate([cv[left], cv[left + 1]], axis=1)
        flags = np.where(count[owner[left]] == 2, PARENT | ROOT, PARENT)
        zero = np.zeros(len(left), np.uint64)
        start = np.tile(np.array(IV, np.uint32), (len(left), 1))
        cv[left] = compress(start, both, zero, zero + np.uint64(64), flags)
        stay = place % 2 == 0
        cv, owner, count = cv[stay], owner[stay], (count + 1) // 2
    return cv
