"""Packing documents into sequences by patterns and non-negative least squares.

Documents are cut into pieces of at most the capacity; only longer ones are cut.
The histogram of piece lengths, one entry per length and so bounded by the
capacity, is all that the driver sees. Lengths are put into coarse bins; every
pattern of up to three bins that fills a sequence is enumerated, and repeat
counts that rebuild the histogram are fitted by non-negative least squares.
They are rounded down, and the pieces left over are packed by best fit, largest
first, first into the room that patterns leave. The result is a plan whose size
doesn't depend on the number of documents: for each length, runs of that
length's pieces, and the sequences they go to. Pieces are numbered within their
length (per task, then over tasks), and so find their run.

Cases: null text is empty and gives one piece that holds the end id alone. A
very long text becomes several pieces. Equal lengths, ids and rows are told
apart by their number. An empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonorel.llm.bpe import load, small_batches
from sonorel.llm.common import bound_arrow_batches, materialize

CAPACITY = 4096
END_ID = 1
#: Coarse bins that patterns are made of.
BINS = 128


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32; part and nth: the piece's task, and its number there among those of its length."""
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for whole in batches:
            for batch in small_batches(whole):
                out: list[list] = [[] for _ in types]
                for doc_id, ids in zip(batch.column(0).to_pylist(), load(path).encode_packed(batch.column(1).to_pylist())):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        n = len(own) // 4
                        for column, value in zip(out, (doc_id, k, at // 4, n, zlib.crc32(own), part, seen[n])):
                            column.append(value)
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(out, types)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )

    bound_arrow_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def patterns(bins: int) -> np.ndarray:
    """All triples a <= b <= c of bins (0: none) that fill a sequence: a + b + c = bins."""
    return np.array([(a, b, bins - a - b) for a in range(bins // 3 + 1) for b in range(a, (bins - a) // 2 + 1)])


def fit(histogram: np.ndarray, shapes: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Repeat counts x >= 0 with sum of x * pattern near the histogram (index: bin), by accelerated projected gradient descent."""
    bins, scale = len(histogram), max(1.0, float(histogram.max(initial=1)))
    target = histogram / scale

    def build(x: np.ndarray) -> np.ndarray:
        out = np.zeros(bins)
        for k in range(3):
            out += np.bincount(shapes[:, k], x, bins)
        out[0] = 0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        r = r.copy()
        r[0] = 0
        return r[shapes].sum(axis=1)

    probe = np.ones(len(shapes))
    for _ in range(30):
        probe = back(build(probe))
        probe /= np.linalg.norm(probe)
    step = 1 / np.linalg.norm(back(build(probe)))
    x = y = np.zeros(len(shapes))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(build(y) - target))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * scale


def plan(counts: dict[int, int], capacity: int = CAPACITY, bins: int = BINS) -> list[tuple[int, list[int]]]:
    """Groups (repeats, lengths) that together hold `counts` pieces of each length; the lengths of a group fit one sequence."""
    left = {n: c for n, c in counts.items() if c}
    width = -(-capacity // bins)
    by_bin: dict[int, list[int]] = defaultdict(list)
    for n in sorted(left):
        by_bin[-(-n // width)].append(n)
    hist = np.zeros(bins + 1)
    for b, ns in by_bin.items():
        hist[b] = sum(left[n] for n in ns)
    groups: list[tuple[int, list[int]]] = []
    shapes = patterns(bins)
    found = fit(hist, shapes) if len(left) else np.zeros(len(shapes))
    for k in np.argsort(-found, kind="stable"):
        want = int(found[k])
        if want < 1:
            break
        own = [int(b) for b in shapes[k] if b]
        while want:
            # The longest lengths that are left in each bin, for as many sequences as they last.
            lengths = []
            for b in own:
                while by_bin[b] and not left[by_bin[b][-1]]:
                    by_bin[b].pop()
                if not by_bin[b]:
                    break
                lengths.append(by_bin[b][-1])
            if len(lengths) < len(own):
                break
            many = min([want, *(left[n] // lengths.count(n) for n in lengths)])
            if not many:  # two of a bin, but one piece of its longest length
                break
            for n in lengths:
                left[n] -= many
            want -= many
            groups.append((many, lengths))
    return best_fit(groups, left, capacity)


def best_fit(groups: list[tuple[int, list[int]]], left: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Adds the pieces left over, longest first, each where the least room remains."""
    by_room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for many, lengths in groups:
        by_room[capacity - sum(lengths)].append((many, lengths))
    rooms = sorted(by_room)

    def put(room: int, group: tuple[int, list[int]]) -> None:
        if not by_room.get(room):
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append(group)

    for n in sorted((n for n, c in left.items() if c), reverse=True):
        c = left[n]
        while c:
            at = bisect.bisect_left(rooms, n)
            if at == len(rooms):
                each = min(capacity // n, c)
                put(capacity - each * n, (c // each, [n] * each))
                c %= each
                continue
            room = rooms[at]
            many, lengths = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
            each = min(room // n, c)
            used = min(many, c // each)
            if used < many:
                put(room, (many - used, lengths))
            put(room - each * n, (used, lengths + [n] * each))
            c -= used * each
    return [g for gs in by_room.values() for g in gs]


def runs_of(groups: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: where its runs of pieces begin, the first sequence of each run, and the offset there."""
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    first = 0
    for many, lengths in groups:
        offset = 0
        for n in lengths:
            found[n].append((used[n], first, offset))
            used[n] += many
            offset += n
        first += many
    return {n: tuple(np.array(x, np.int64) for x in zip(*rows)) for n, rows in found.items()}


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialize(cut_pieces(docs, path, capacity, end_id), "pieces")
    per_task = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = runs_of(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    numbered = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = pieces.join(numbered, ["part", "length"]).withColumn("nth", F.col("nth") + F.col("base"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, nth = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(nth), np.int64), np.zeros(len(nth), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for own in np.split(order, cuts) if len(order) else []:
                begin, first, at = runs[int(length[own[0]])]
                k = np.searchsorted(begin, nth[own], side="right") - 1
                sequence[own], offset[own] = first[k] + nth[own] - begin[k], at[k]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                [*columns, "sequence_id", "offset"],
            )

    return numbered.select(*columns, "nth").mapInArrow(
        place,
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    )
