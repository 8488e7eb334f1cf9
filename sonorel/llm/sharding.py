"""Sharding by fixed virtual slots.

Records hash into a fixed number of virtual slots (thousands, far more than
shards). Bytes are aggregated per slot, and a slot-to-shard map, stored with a
version, sends slots to shards. Rebalancing edits the map and never rehashes a
record: a new version moves as few slots as give near-equal bytes.

The map and the per-slot totals have one row per slot, so their size is bounded
by the number of slots, whatever the input.

Cases: null text has no bytes (its size is the overhead alone). A slot is chosen
by hash of the id and the text's checksum, so copies of a text spread over the
slots, and rows with a null id are spread as far as their texts differ. Rows that
repeat an id and a text are counted, and the number of a repeat joins the hash:
the first is where a single one would be, the others spread over all slots, so no
slot and no shard is filled by them. An empty table gives an empty result and a
map that deals slots evenly. Other columns are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonorel.llm.common import materialize

#: Bytes that a record takes besides its text.
OVERHEAD = 16
SLOTS = 8192
#: Repeats of a row that are written out at a time.
REPEATS = 100

Map = list[int]  #: the shard of each slot


def with_slot(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot.

    Repeats are counted within tasks before the shuffle, and written out again in two
    steps, by hundreds and then singly, so that no task gives out all of a key's rows."""
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD
    key = ["doc_id", "size", "text_crc32"]
    counted = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32")).groupBy(*key).agg(F.count("*").alias("n"))
    counted = materialize(counted, "counted")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    many = counted.where(F.col("n") > REPEATS)
    parts = many.select(*key, "n", upto(F.ceil(F.col("n") / REPEATS)).alias("part")).repartition(*key, "part")
    each = parts.select(
        *key,
        (F.col("part") * REPEATS).alias("base"),
        F.least(F.lit(REPEATS), F.col("n") - F.col("part") * REPEATS).alias("n"),
    )
    rows = counted.where(F.col("n") <= REPEATS).select(*key, F.lit(0).cast("long").alias("base"), "n").unionByName(each)
    repeat = rows.select(*key, "base", upto(F.col("n")).alias("k")).withColumn("k", F.col("base") + F.col("k"))
    name = F.when(F.col("k") == 0, F.xxhash64("doc_id", "text_crc32")).otherwise(F.xxhash64("doc_id", "text_crc32", "k"))
    return repeat.select(*key, F.pmod(name, F.lit(slots)).cast("int").alias("vslot"))


def slot_bytes(slotted: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot: at most `slots` rows come to the driver."""
    size, rows = [0] * slots, [0] * slots
    for r in slotted.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        size[r.vslot], rows[r.vslot] = r.b, r.n
    return size, rows


def first_map(size: list[int], shards: int) -> Map:
    """Largest slot first, each to the shard with the fewest bytes so far."""
    heap = [(0, 0, s) for s in range(shards)]
    out = [0] * len(size)
    for slot in sorted(range(len(size)), key=lambda k: (-size[k], k)):
        held, n, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (held + size[slot], n + 1, shard))
    return out


def rebalance(old: Map, size: list[int], shards: int) -> Map:
    """The edited map for another number of shards: slots of shards that go, then slots of the fullest shards, move to where there is room."""
    new = list(old)
    held = [0] * shards
    homeless = []
    own: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(old):
        if shard < shards:
            held[shard] += size[slot]
            own[shard].append(slot)
        else:
            homeless.append(slot)
    goal = sum(size) / shards
    for shard in range(shards):
        for slot in sorted(own[shard], key=lambda k: (size[k], k)):
            if size[slot] and held[shard] - size[slot] >= goal:
                held[shard] -= size[slot]
                homeless.append(slot)
    heap = [(h, s) for s, h in enumerate(held)]
    heapq.heapify(heap)
    for slot in sorted(homeless, key=lambda k: (-size[k], k)):
        h, s = heapq.heappop(heap)
        new[slot] = s
        heapq.heappush(heap, (h + size[slot], s))
    return new


def store_map(spark: SparkSession, path: str, version: int, mapped: Map) -> None:
    """Adds one version of the map. A version never changes once written: a second try raises an error."""
    rows = [(slot, shard) for slot, shard in enumerate(mapped)]
    one = spark.createDataFrame(rows, "vslot int, shard int").coalesce(1)
    one.write.mode("errorifexists").parquet(f"{path.rstrip('/')}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> Map:
    """One version of the map, the latest by default; LookupError if it isn't there."""
    table = spark.read.schema("vslot int, shard int, version int").parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    rows = table.where(F.col("version") == version).select("vslot", "shard").collect()
    if not rows:
        raise LookupError(f"{path} holds no version {version} of the map")
    out = [0] * len(rows)
    for r in rows:
        out[r.vslot] = r.shard
    return out


def assign(slotted: DataFrame, mapped: Map, rows: list[int]) -> DataFrame:
    """Adds shard and slot, the record's place in its shard, gapless from 0: the places of a shard's slots follow one another, and records are numbered within their slot."""
    spark = slotted.sparkSession
    start: list[int] = []
    filled: dict[int, int] = {}
    for v, shard in enumerate(mapped):
        start.append(filled.get(shard, 0))
        filled[shard] = start[-1] + rows[v]
    plan = spark.createDataFrame([(v, s, b) for v, (s, b) in enumerate(zip(mapped, start))], "vslot int, shard int, base long")
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return slotted.withColumn("place", place).join(F.broadcast(plan), "vslot").withColumn(
        "slot",
        F.col("base") + F.col("place") - 1,
    ).drop("place", "base")


def has_map(spark: SparkSession, path: str, version: int) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/version={version}")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def shard_documents(docs: DataFrame, shards: int, slots: int = SLOTS, map_path: str | None = None, version: int = 1) -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard, slot. Sizes of shards come out near equal.

    With a path, the stored version of the map holds; one that isn't there yet is made from the bytes per slot, stored
    and read back."""
    slotted = materialize(with_slot(docs, slots), "slots")
    size, rows = slot_bytes(slotted, slots)
    if not map_path:
        return assign(slotted, first_map(size, shards), rows)
    if not has_map(docs.sparkSession, map_path, version):
        store_map(docs.sparkSession, map_path, version, first_map(size, shards))
    return assign(slotted, load_map(docs.sparkSession, map_path, version), rows)


def rebalance_stored(docs: DataFrame, shards: int, map_path: str, version: int) -> Map:
    """Edits the stored version for these documents and another number of shards, and stores the outcome as the next version."""
    old = load_map(docs.sparkSession, map_path, version)
    size, _ = slot_bytes(materialize(with_slot(docs, len(old)), "slots"), len(old))
    new = rebalance(old, size, shards)
    store_map(docs.sparkSession, map_path, version + 1, new)
    return new
