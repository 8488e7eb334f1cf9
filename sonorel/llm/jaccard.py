"""Exact Jaccard join of documents' shingle sets in the metric 1 - Jaccard.

Copies, sets that are equal, are joined first; one representative of each goes
on. Shingles have a global order, common ones last, and two sets that are
similar enough share one of the first few of each (the prefix). For every
shingle, the smallest representative that has it in its prefix is the pivot, so
each document has a handful of pivots, and two similar documents share one: the
pivots' regions together hold every link. A document whose prefix reaches into
several regions is replicated to each. Prefixes are a little longer than one
common shingle needs, so similar sets have several in common there; sets that
share fewer with others of a fitting size (|y| is within NEED / OF of |x|, by the
triangle inequality about the empty set) have no link and leave early.

A region is joined exactly. Distances to a pivot are computed for the whole
region at once; documents within the threshold are linked, and by the triangle
inequality only documents whose distances to the pivots differ by at most the
threshold can still be linked. New pivots are taken from what is left, again and
again, until no two components can meet. Regions of more than REGION documents
are dealt into blocks that are joined with their pivot; then those documents
that stayed apart from the pivot's component, and only those, meet every block.

The order of shingles is a matter of cost alone. Common shingles are those that
many documents have among their smallest hashes; their number is bounded by raising
the count that makes one common.

Cases: null and empty texts, and those without words, have no shingles and stand
alone. With a null doc_id, the smallest id of the group that isn't null is its
component; rows that repeat are copies of each other. An empty table gives no
rows. Texts are read whole, whatever their length. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonorel.llm.bpe import small_batches
from sonorel.llm.common import bound_arrow_batches, broadcast_if_small, column, drop_table, materialize
from sonorel.llm.components import components
from sonorel.llm.shingles import digest, shingle_sets

#: Similarity of at least NEED / OF makes a link.
NEED, OF = 75, 100
#: A longer prefix, by this share of the set, in which similar sets must have as much in common.
EXTRA = 10
REGION = 2000
#: Pivots of a cell; cells of so few documents, or those that keep more than this share of the cell before, aren't divided.
PIVOTS, LEAF, SHRINK = 6, 24, 0.9
#: Shingles of the sets that a task joins at a time.
REGION_SHINGLES = 1_000_000
COMMON = 32
#: Common shingles, at most; with a pivot for each of about 30 classes of sizes they take less than 64 MB in a task.
MOST_COMMON = 1 << 17
#: Hashes that a task of the exchange gets at a time, about.
BUCKET_ROWS = 400_000


def prefix_size(n: int) -> int:
    """So many of a set's first shingles hold at least extra(n) of those that it has in common with a similar set."""
    return n - -(-NEED * n // OF) + extra(n)


def extra(n: int) -> int:
    return -(-EXTRA * n // OF)


def company(n: int) -> int:
    """The prefixes of similar sets have extra() of the smaller set in common: the least that the prefix of a set of n shares with others, if it has a link."""
    return extra(-(-NEED * n // OF))


class Keys:
    """Shingles by the leading bits of their hashes, enough of them that different shingles of a corpus hardly ever
    meet (if they do, that costs a comparison and changes nothing): the first `bits` are a bucket of the exchange, and
    32 more follow. Packed, a key takes four bytes and as few more as its bucket needs."""

    def __init__(self, bits: int):
        self.bits = bits
        self.wide = np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32
        self.shift = np.uint64(32 - bits)

    def of(self, shingles: np.ndarray) -> np.ndarray:
        return shingles >> self.shift

    def pack(self, keys: np.ndarray) -> bytes:
        return keys.astype(np.uint32).tobytes() + (keys >> np.uint64(32)).astype(self.wide).tobytes()

    def unpack(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All keys of a column of packed sets, and the row of each."""
        raws = column.to_pylist()
        each = 4 + np.dtype(self.wide).itemsize
        sizes = [len(r) // each for r in raws]
        low = np.frombuffer(b"".join([r[: 4 * n] for r, n in zip(raws, sizes)]), np.uint32)
        high = np.frombuffer(b"".join([r[4 * n :] for r, n in zip(raws, sizes)]), self.wide)
        return low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)), np.repeat(np.arange(len(raws)), sizes)

    def by_bucket(self, keys: np.ndarray) -> list[tuple[int, int, int]]:
        """(bucket, first, end) of a sorted array."""
        if not len(keys):
            return []
        buckets = keys >> np.uint64(32)
        cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(keys)]
        return [(int(buckets[a]), a, b) for a, b in zip(cuts, cuts[1:])]


def found_at(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x in a sorted array, and whether it is there."""
    at = np.minimum(np.searchsorted(sorted_, x), max(0, len(sorted_) - 1))
    return at, sorted_[at] == x if len(sorted_) else np.zeros(len(x), bool)


def ordered_prefix(shingles: np.ndarray, keys: Keys, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Keys of the first shingles in the order: uncommon ones by hash, then common ones by count and hash."""
    size, key = prefix_size(len(shingles)), keys.of(shingles)
    at, hit = found_at(common, key)
    rare = key[~hit]
    if len(rare) >= size:
        return rare[:size]
    own = key[hit]
    return np.concatenate([rare, own[np.lexsort((own, counts[at[hit]]))][: size - len(rare)]])


def name_of(text: Column) -> Column:
    """Tells texts apart: with the doc_id, it names a row (or rows that repeat one another)."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def measured(docs: DataFrame, keys: Keys, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """doc_id, name, n, digest, prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole):
                sets = shingle_sets(batch.column(2).to_pylist())
                digests = pa.array([digest(s) if len(s) else None for s in sets], pa.binary())
                prefixes = pa.array(
                    [keys.pack(ordered_prefix(s, keys, common, counts)) if len(s) else None for s in sets],
                    pa.binary(),
                )
                columns = [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), digests, prefixes]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "name", "n", "digest", "prefix"])

    named = docs.select("doc_id", name_of(F.col("text")).alias("name"), "text")
    return named.mapInArrow(run, "doc_id bigint, name binary, n bigint, digest binary, prefix binary")


def sets_of(docs: DataFrame) -> DataFrame:
    """digest, shingles: of documents that have some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole):
                sets = [s for s in shingle_sets(batch.column(0).to_pylist()) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["digest", "shingles"],
                )

    return docs.select("text").mapInArrow(run, "digest binary, shingles binary")


def common_shingles(docs: DataFrame, keys: Keys) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of shingles that many documents have among their smallest hashes, and how many: at most MOST_COMMON of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: list[np.ndarray]) -> pa.RecordBatch:
            flat, n = np.unique(np.concatenate(held), return_counts=True)
            out = []
            for b, x, y in keys.by_bucket(flat):
                many = n[x:y] > 1
                low = flat[x:y].astype(np.uint32)
                out.append((b, low[~many].tobytes(), low[many].tobytes(), n[x:y][many].astype(np.uint32).tobytes()))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                ["bucket", "once", "more", "n"],
            )

        held, size = [], 0
        for whole in batches:
            for batch in small_batches(whole):
                own = [keys.of(s[: prefix_size(len(s))]) for s in shingle_sets(batch.column(0).to_pylist()) if len(s)]
                held += own
                size += sum(map(len, own))
                if size > 2_000_000:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    def add(rows: pa.Table) -> pa.Table:
        once, more, n = (np.frombuffer(b"".join(rows[c].to_pylist()), np.uint32) for c in ("once", "more", "n"))
        low, at = np.unique(np.concatenate([once, more]), return_inverse=True)
        total = np.bincount(at, np.concatenate([np.ones(len(once)), n]), minlength=len(low)).astype(np.int64)
        keep = total >= COMMON
        bucket = rows["bucket"][0].as_py()
        return pa.table({"h": (low[keep].astype(np.int64) | (bucket << 32)), "n": total[keep]})

    found = materialize(
        docs.select("text").mapInArrow(
            count,
            "bucket long, once binary, more binary, n binary",
        ).groupBy("bucket").applyInArrow(add, "h long, n long"),
        "common",
    )
    total, least = 0, COMMON
    for r in found.groupBy(F.floor(F.log2("n")).alias("e")).count().orderBy(F.desc("e")).collect():
        total += r["count"]
        if total > MOST_COMMON:
            least = 2 << r.e
            break
    rows = found.where(F.col("n") >= least).toArrow()
    flat, n = rows["h"].to_numpy().astype(np.uint64), rows["n"].to_numpy()
    order = np.argsort(flat)
    return flat[order], n[order]


def size_classes(n: np.ndarray) -> np.ndarray:
    """Logarithmic classes of set sizes: sets that are similar enough are in the same class or in neighbouring ones."""
    return np.floor(np.log(n) / np.log(OF / NEED) + 1e-9).astype(np.int64)


def common_keys(flat: np.ndarray, row: np.ndarray, n: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the common shingles of prefixes: (shingle, class of sizes) as one number, and the row. Each set also goes to
    the class above its own, so that neighbouring classes meet there."""
    at, hit = found_at(common, flat)
    key = at[hit] * 256 + size_classes(n[row[hit]])
    return np.concatenate([key, key + 1]), np.concatenate([row[hit], row[hit]])


def pivots_of_common(reps: DataFrame, keys: Keys, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of common shingles that at least two prefixes have, and the smallest representative of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, row = common_keys(*keys.unpack(batch.column(1)), batch.column(2).to_numpy(), common)
            nid = batch.column(0).to_numpy()[row]
            order = np.lexsort((nid, key))
            key, nid = key[order], nid[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key[first], pa.int64()),
                    pa.array(nid[first], pa.int64()),
                    pa.array(np.diff(np.append(first, len(key))), pa.int64()),
                ],
                ["k", "nid", "n"],
            )

    found = reps.select("nid", "prefix", "n").mapInArrow(run, "k long, nid long, n long").groupBy("k").agg(
        F.min("nid").alias("nid"),
        F.sum("n").alias("n"),
    ).where("n > 1").toArrow()
    k, nid = found["k"].to_numpy(), found["nid"].to_numpy()
    order = np.argsort(k)
    return k[order], nid[order]


#: Sets' sizes in the exchange, by powers of this; those more than APART powers apart can't be similar.
POWER, APART = 1.1, 4


def dealt(reps: DataFrame, keys: Keys, common: np.ndarray, schema: str, use) -> DataFrame:
    """use(nid, first, size, many) for the sets that uncommon shingles bring together. Prefixes are dealt out by shingle;
    a shingle's sets are sorted by size, and cut where the next is too large for any before it."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, row = keys.unpack(batch.column(1))
            rare = ~found_at(common, flat)[1]
            flat, row = flat[rare], row[rare]
            order = np.argsort(flat, kind="stable")
            flat, row = flat[order], row[order]
            nid, power = batch.column(0).to_numpy(), np.floor(np.log(batch.column(2).to_numpy()) / np.log(POWER)).astype(np.uint8)
            # Ids are numbered from a few bases, one for each file that they come from.
            bases = nid >> 32
            for base in np.unique(bases):
                own = bases[row] == base
                f, i, p = flat[own], (nid[row[own]] & 0xFFFFFFFF).astype(np.uint32), power[row[own]]
                rows = [
                    (
                        b,
                        int(base),
                        f[x:y].astype(np.uint32).tobytes(),
                        i[x:y].tobytes(),
                        p[x:y].tobytes(),
                    ) for b, x, y in keys.by_bucket(f)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                    ["bucket", "base", "h", "nid", "power"],
                )

    def meet(rows: pa.Table) -> pa.Table:
        flat, low, power = (
            np.frombuffer(b"".join(rows[c].to_pylist()), t) for c, t in (
                ("h", np.uint32),
                ("nid", np.uint32),
                ("power", np.uint8),
            )
        )
        nid = low.astype(np.int64) | np.repeat(
            np.array(rows["base"].to_pylist(), np.int64) << 32,
            [len(x) for x in rows["power"].to_pylist()],
        )
        order = np.lexsort((nid, power, flat))
        flat, nid, power = flat[order], nid[order], power[order].astype(np.int64)
        first = np.append(0, np.flatnonzero((flat[1:] != flat[:-1]) | (power[1:] - power[:-1] > APART)) + 1)
        size = np.diff(np.append(first, len(flat)))
        return use(nid, first, size, np.repeat(size, size) > 1)

    return reps.select("nid", "prefix", "n").mapInArrow(
        deal,
        "bucket long, base long, h binary, nid binary, power binary",
    ).groupBy("bucket").applyInArrow(meet, schema)


def in_company(reps: DataFrame, keys: Keys, common: np.ndarray) -> DataFrame:
    """The representatives whose prefixes share enough shingles with others of a fitting size."""
    shared_keys, _ = pivots_of_common(reps, keys, common) if len(common) else (np.zeros(0, np.int64), None)

    def count(nid: np.ndarray, first: np.ndarray, size: np.ndarray, many: np.ndarray) -> pa.Table:
        ids, n = np.unique(nid[many], return_counts=True)
        return pa.table({"nid": ids, "shared": n})

    def of_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, row = common_keys(*keys.unpack(batch.column(1)), batch.column(2).to_numpy(), common)
            hit = found_at(shared_keys, key)[1]
            half = len(key) // 2  # each shingle stands in either half, with its two classes
            n = np.bincount(row[:half][hit[:half] | hit[half:]], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["nid", "shared"])

    out = dealt(reps, keys, common, "nid long, shared long", count)
    if len(common):
        out = out.union(reps.select("nid", "prefix", "n").mapInArrow(of_common, "nid long, shared long"))
    shared = out.groupBy("nid").agg(F.sum("shared").alias("shared"))
    up = lambda x, by: F.floor((x * by + OF - 1) / OF)
    enough = shared.join(reps.select("nid", "n"), "nid").where(F.col("shared") >= up(up(F.col("n"), NEED), EXTRA)).select("nid")
    return reps.join(broadcast_if_small(materialize(enough, "enough")), "nid", "left_semi")


def memberships(reps: DataFrame, keys: Keys, common: np.ndarray) -> DataFrame:
    """nid, pivot, shared: the regions of each representative, and how many shingles of its prefix lead there; a pivot
    is a member of its own. Sets whose sizes are too far apart never share a region by a shingle that few have."""
    shared_keys, firsts = pivots_of_common(reps, keys, common) if len(common) else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def pairs(nid: np.ndarray, pivot: np.ndarray) -> pa.Table:
        both, n = np.unique(np.stack([nid, pivot], 1), axis=0, return_counts=True)
        return pa.table({"nid": both[:, 0], "pivot": both[:, 1], "shared": n})

    def regions(nid: np.ndarray, first: np.ndarray, size: np.ndarray, many: np.ndarray) -> pa.Table:
        return pairs(nid[many], np.repeat(np.minimum.reduceat(nid, first), size)[many])

    def of_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, row = common_keys(*keys.unpack(batch.column(1)), batch.column(2).to_numpy(), common)
            at, hit = found_at(shared_keys, key)
            yield from pairs(batch.column(0).to_numpy()[row[hit]], firsts[at[hit]]).to_batches()

    out = dealt(reps, keys, common, "nid long, pivot long, shared long", regions)
    if len(common):
        out = out.union(reps.select("nid", "prefix", "n").mapInArrow(of_common, "nid long, pivot long, shared long"))
    return out.groupBy("nid", "pivot").agg(F.sum("shared").alias("shared"))


class Region:
    """The exact join of the documents of a region (or of one of its blocks), by Voronoi cells within cells."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        doc = np.repeat(np.arange(len(sets)), self.size)
        _, token = np.unique(flat, return_inverse=True)
        order = np.argsort(token, kind="stable")
        self.posting = doc[order]
        self.starts = np.append(0, np.cumsum(np.bincount(token)))
        self.tokens = np.split(token, np.cumsum(self.size)[:-1])
        self.out: list[tuple[int, int]] = []

    def distances(self, i: int) -> np.ndarray:
        """Of all documents to one, which is linked with those that are near."""
        own = self.tokens[i]
        a, n = self.starts[own], self.starts[own + 1] - self.starts[own]
        at = np.repeat(a - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        shared = np.bincount(self.posting[at], minlength=len(self.size))
        union = self.size + self.size[i] - shared
        near = np.flatnonzero(OF * shared >= NEED * union)
        for j in near[self.label[near] != self.label[i]].tolist():
            if self.label[j] != self.label[i]:
                self.out.append((i, j))
                self.label[self.label == self.label[j]] = self.label[i]
        return 1 - shared / union

    def one_by_one(self, own: np.ndarray, guests: np.ndarray) -> None:
        """Each document of a cell that won't shrink meets the others, unless its links are known."""
        for at, i in enumerate(own.tolist()):
            others = np.concatenate([own[at + 1 :], guests])
            others = others[self.label[others] != self.label[i]]
            if (OF * np.minimum(self.size[others], self.size[i]) >= NEED * np.maximum(self.size[others], self.size[i])).any():
                self.distances(i)

    def links(self, first: int, asked: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
        """Links that connect what is connected. first: the pivot to begin with. asked: the documents that have yet to
        meet all others. label: their components so far.

        A cell is its own documents, which meet one another and the cell's guests. Its pivots are measured against all of
        it, and each of its own goes to the nearest pivot. Two that are linked differ by at most the threshold in their
        distance to any pivot, so whoever is linked with an own document of a cell is no farther from its pivot than from
        the nearest one by more than twice the threshold: those are the cell's guests."""
        self.label, self.out = label.copy(), []
        cells = [(np.flatnonzero(asked), np.flatnonzero(~asked), first)]
        while cells:
            own, guests, seed = cells.pop()
            if not len(own) or len(np.unique(self.label[np.concatenate([own, guests])])) < 2:
                continue
            if len(own) <= LEAF:
                self.one_by_one(own, guests)
                continue
            pivots, far = [], []
            for _ in range(PIVOTS):
                # The next pivot is the farthest from those before.
                pivots.append(seed if not far and seed >= 0 else int(own[np.argmax(np.min(far, 0)[own])] if far else own[0]))
                far.append(self.distances(pivots[-1]))
            far = np.stack(far)
            least, home = far.min(0), far.argmin(0)
            reach = least + 2 * (1 - NEED / OF) + 1e-9
            parts = []
            for k in range(len(pivots)):
                mine = own[home[own] == k]
                others = np.concatenate([own[home[own] > k], guests])
                parts.append((mine[~np.isin(mine, pivots)], others[far[k, others] <= reach[others]], -1))
            if max(len(m) + len(g) for m, g, _ in parts) > SHRINK * (len(own) + len(guests)):
                self.one_by_one(own[~np.isin(own, pivots)], guests)
            else:
                cells += parts
        return self.out


def region_links(placed: DataFrame) -> DataFrame:
    """a, b from the blocks: region, part, nid, asked, root (the component so far), shingles."""

    def join(rows: pa.Table) -> pa.Table:
        by_id: dict[int, tuple[bytes, bool, int]] = {}
        for nid, raw, asked, root in zip(*(rows[c].to_pylist() for c in ("nid", "shingles", "asked", "root"))):
            by_id[nid] = (raw, asked or by_id.get(nid, (b"", False, 0))[1], root)
        ids = sorted(by_id)
        region, asked = rows["region"][0].as_py(), np.array([by_id[i][1] for i in ids])
        _, label = np.unique([by_id[i][2] for i in ids], return_inverse=True)
        found = []
        if len(set(label.tolist())) > 1:
            found = Region([np.frombuffer(by_id[i][0], np.uint64) for i in ids]).links(
                ids.index(region) if region in by_id else int(asked.argmax()),
                asked,
                label,
            )
        return pa.table(
            {"a": pa.array([ids[i] for i, _ in found], pa.int64()), "b": pa.array([ids[j] for _, j in found], pa.int64())}
        )

    return placed.groupBy("region", "part").applyInArrow(join, "a long, b long")


def links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links between representatives that connect exactly those that the similarity connects. members: nid, n, pivot, shared; sets: nid, shingles.

    First each document meets the region of its nearest pivot, the one that most of its prefix leads to. Regions whose
    members are then all connected have nothing left to tell. In the others, those apart from the pivot's component meet all members."""
    blocks_for = F.ceil(F.greatest(F.count("*") / F.lit(REGION), F.sum("n") / F.lit(REGION_SHINGLES))).cast("int")
    # Regions of one block need no entry, so those of several make a small table, and no region's members gather.
    large = materialize(members.groupBy("pivot").agg(blocks_for.alias("parts")).where("parts > 1"), "large-regions")
    members = members.join(broadcast_if_small(large), "pivot", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    members = materialize(members.withColumn("block", F.pmod(F.xxhash64("nid"), F.col("parts")).cast("int")), "members")
    nearest = F.max_by(
        F.struct("pivot", "parts", "block"),
        F.struct((F.col("nid") != F.col("pivot")).cast("int"), "shared", "pivot"),
    )
    own = members.where("nid <> pivot").groupBy("nid").agg(nearest.alias("r")).select(
        F.col("r.pivot").alias("region"),
        F.col("r.block").alias("part"),
        "nid",
    )
    # The pivot joins every block of its region.
    blocks = own.union(own.select("region", "part", F.col("region").alias("nid")).distinct())
    columns = ["region", "part", "nid", "asked", "root", "shingles"]
    found = materialize(
        region_links(blocks.withColumns({"asked": F.lit(True), "root": F.col("nid")}).join(sets, "nid").select(*columns)),
        "links",
    )
    roots = components(found)
    root = lambda df, c, name: df.join(
        broadcast_if_small(roots.select(F.col("a").alias(c), F.col("b").alias(name))),
        c,
        "left",
    ).withColumn(name, F.coalesce(name, c))
    placed = materialize(
        root(root(members, "nid", "root"), "pivot", "pivot_root").select(
            "pivot",
            "nid",
            "n",
            "parts",
            "block",
            "root",
            "pivot_root",
        ),
        "placed",
    )
    stray = placed.where("root <> pivot_root")
    n = broadcast_if_small(materialize(stray.groupBy("pivot").agg(blocks_for.alias("turns")), "turns"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    turn = F.pmod(F.xxhash64("nid", F.lit(1)), F.col("turns")).cast("int")
    asked = stray.join(n, "pivot").withColumn("turn", turn).select(
        "pivot",
        "nid",
        "root",
        each("parts").alias("block"),
        "turn",
        F.lit(True).alias("asked"),
    )
    met = placed.join(n, "pivot").select(
        "pivot",
        "nid",
        "root",
        "block",
        each("turns").alias("turn"),
        F.lit(False).alias("asked"),
    )
    again = asked.union(met).groupBy("pivot", "nid", "root", "block", "turn").agg(F.max("asked").alias("asked"))
    again = again.select(
        F.col("pivot").alias("region"),
        (F.col("block").cast("long") * (1 << 32) + F.col("turn")).alias("part"),
        "nid",
        "asked",
        "root",
    )
    return found.union(materialize(region_links(again.join(sets, "nid").select(*columns)), "links"))


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, name (of the text), n, root (the same for all that links connect; null without shingles), least_id (the smallest doc_id that isn't null of these)."""
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keys = Keys(min(32, max(8, (size // 16 // BUCKET_ROWS).bit_length())))
    common, counts = common_shingles(docs, keys)
    first = materialize(measured(docs, keys, common, counts), "measured")
    rows = materialize(first.select("doc_id", "name", "n", "digest"), "rows")
    reps = first.where("n > 0").groupBy("digest").agg(
        F.min("doc_id").alias("least_id"),
        F.first("n").alias("n"),
        F.first("prefix").alias("prefix"),
    )
    reps = materialize(reps.withColumn("nid", F.monotonically_increasing_id()), "representatives")
    drop_table(spark, first)
    names = materialize(reps.select("nid", "digest", "least_id"), "names")
    some = materialize(in_company(reps, keys, common), "in-company")
    drop_table(spark, reps)
    members = materialize(memberships(some, keys, common).join(some.select("nid", "n"), "nid"), "memberships")
    drop_table(spark, some)
    wanted = members.where("nid <> pivot").select(F.explode(F.array("nid", "pivot")).alias("nid")).distinct()
    wanted = materialize(names.join(wanted, "nid", "left_semi"), "wanted")
    texts = docs.select("doc_id", "text").join(
        broadcast_if_small(wanted.select(F.col("least_id").alias("_id"))),
        F.col("doc_id").eqNullSafe(F.col("_id")),
        "left_semi",
    )
    sets = sets_of(texts).groupBy("digest").agg(F.first("shingles").alias("shingles"))
    sets = materialize(sets.join(wanted.select("digest", "nid"), "digest").select("nid", "shingles"), "sets")
    drop_table(spark, wanted)
    roots = components(links(members, sets))
    drop_table(spark, sets)
    rooted = names.join(
        roots.select(F.col("a").alias("nid"), F.col("b").alias("root")),
        "nid",
        "left",
    ).withColumn("root", F.coalesce("root", "nid"))
    rooted = materialize(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    labels = rooted.join(least, "root").select("digest", "root", "component_id")
    return rows.join(labels, "digest", "left").select("doc_id", "name", "n", "root", F.col("component_id").alias("least_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links reach."""
    component = F.when(F.col("n") > 0, F.col("least_id")).otherwise(F.col("doc_id"))
    return labelled(docs).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, one row of each group that links connect: that of the smallest doc_id (null last), of several with
    it that of the smallest name of the text. Rows that repeat id and text are in one group, so one of them stays.
    Documents without words are in no group and stay. All columns stay."""
    found = materialize(
        labelled(docs).where("root is not null").groupBy("root", "doc_id", "name").agg(F.count("*").alias("n")),
        "grouped",
    )
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "name")
    best = found.groupBy("root").agg(F.min(order).alias("best"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    best = broadcast_if_small(materialize(best, "kept"))
    gone = F.col("best").isNotNull() & (order != F.col("best"))
    marks = found.join(best, "root", "left").select(
        F.col("doc_id").alias("_i"),
        F.col("name").alias("_n"),
        gone.alias("gone"),
        "n",
    )
    marks = materialize(marks.where("gone or n > 1").drop("n"), "marks")
    repeated = bool(marks.where("not gone").take(1))
    row = F.struct(*map(column, docs.columns)).alias("row")
    named = docs.select(row).select("row", F.col("row.doc_id").alias("_id"), name_of(F.col("row.text")).alias("_name"))
    marked = named.join(broadcast_if_small(marks), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_name") == F.col("_n")), "left")
    kept = marked.where("gone is null").select("row")
    if repeated:
        kept = kept.unionByName(marked.where("not gone").groupBy("_id", "_name").agg(F.first("row").alias("row")).select("row"))
    return kept.select(*[column(c, "row").alias(c) for c in docs.columns])


ORACLE_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (sh) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {OF} * c >= {NEED} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.m)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(m) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""
