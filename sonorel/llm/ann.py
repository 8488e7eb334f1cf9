"""Approximate nearest neighbours: one small-world graph per shard, results merged.

Equal vectors form a class that is indexed once, with its k + 1 smallest ids
(more can never be among k answers, nor can they crowd out the query's other
neighbours). Classes are dealt by hash into shards, whose number of rows grows with
the table up to a bound. Each shard builds a hierarchical navigable small-world graph
by inserting its vectors one block after another (hnsw.py), and is stored as one row
of flat arrays. Queries meet every shard in blocks; what a shard's beam holds is
measured again in double precision on the original vectors, and the shards' nearest
are merged. Shards are dealt by hash and all asked, as routing by centroids loses too
much where vectors have no clusters (see the README).

Cases: vectors that are null, empty, zero or hold null or non-finite components
take no part, nor do rows with a null id. Vectors of different lengths never
meet. Ties go to the smaller id. With fewer than k other rows, all are returned.
Rows that repeat an id are never that id's neighbours; if their vectors differ, each
vector that is asked for has its own ranking, and a neighbour counts with the nearest
of its vectors. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonorel.llm.common import broadcast_if_small, materialize
from sonorel.llm.hnsw import BEAM, LINKS, Graph

#: A shard's rows: a part of the table's, between these bounds, and no more than fit the bytes.
LEAST_ROWS, MOST_ROWS, PARTS = 16_384, 65_536, 64
SHARD_BYTES = 64 << 20
QUERY_BLOCK = 1024
#: Larger components are scaled down before single precision squares them.
LARGE = 1e15

INDEX = "dim int, shard bigint, links int, scale double, ids array<bigint>, vectors binary, sizes array<int>, neighbours binary"


def valid(rows: DataFrame, vector: str) -> DataFrame:
    """vec_id, v (double unless it is float; no negative zero) of the rows that take part."""
    v = F.col(vector)
    single = isinstance(rows.schema[vector].dataType.elementType, T.FloatType)
    kind = "float" if single else "double"
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    some = rows.where(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))
    return some.select("vec_id", F.transform(v, lambda x: x.cast(kind) + F.lit(0.0).cast(kind)).alias("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def classes(rows: DataFrame, vector: str, k: int) -> DataFrame:
    """vec_id, v, nth, class_id (smallest id of the equal vectors): the k + 1 smallest ids of each class. The limit is taken within tasks before rows are shuffled, so a common vector gathers nowhere."""
    own = Window.partitionBy("v").orderBy("vec_id")
    top = valid(rows, vector).withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= k + 1)
    return top.withColumn("class_id", F.min("vec_id").over(Window.partitionBy("v")))


def build_index(members: DataFrame, shard_rows: int | None = None, links: int = LINKS) -> DataFrame:
    """One row per shard: its class ids, vectors and flat neighbour arrays."""
    reps = members.where("nth = 1").select("class_id", "v", F.size("v").alias("dim"))
    fit = F.floor(SHARD_BYTES / (8 * F.col("dim")))
    each: Column = F.lit(shard_rows) if shard_rows else F.least(
        F.lit(MOST_ROWS),
        F.greatest(F.lit(LEAST_ROWS), F.floor(F.col("n") / PARTS)),
        F.greatest(fit, F.lit(1)),
    )
    sizes = reps.groupBy("dim").agg(F.count("*").alias("n")).select("dim", F.ceil(F.col("n") / each).alias("shards"))

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        dim, shard = key[0].as_py(), key[1].as_py()
        rows = rows.sort_by("class_id")
        vectors = matrix(rows.column("v").combine_chunks(), dim)
        scale = max(1.0, float(np.abs(vectors).max()) / LARGE)
        graph, order = Graph.build((vectors / scale).astype(np.float32), links)
        packed = graph.pack()
        ids = np.asarray(rows.column("class_id"))[order]
        row = {
            "dim": dim,
            "shard": shard,
            "links": links,
            "scale": scale,
            "ids": ids,
            "vectors": vectors[order].tobytes(),
            **packed,
        }
        kinds = [
            pa.int32(),
            pa.int64(),
            pa.int32(),
            pa.float64(),
            pa.list_(pa.int64()),
            pa.binary(),
            pa.list_(pa.int32()),
            pa.binary(),
        ]
        return pa.table(
            {name: pa.array([row[name]], kind) for name, kind in zip(("dim", "shard", "links", "scale", "ids", "vectors", "sizes", "neighbours"), kinds)}
        )

    dealt = reps.join(broadcast_if_small(materialize(sizes, "sizes")), "dim")
    dealt = dealt.select("class_id", "v", "dim", F.pmod(F.xxhash64("class_id"), F.col("shards")).alias("shard"))
    return materialize(dealt.groupBy("dim", "shard").applyInArrow(build, INDEX), "graphs")


def search_index(index: DataFrame, queries: DataFrame, k: int, beam: int = BEAM) -> DataFrame:
    """query_id, name, class_id, score: the k nearest classes that each shard finds. queries: query_id, name (of the vector), v."""
    rows = queries.select("query_id", "name", "v", F.size("v").alias("dim"))
    blocks = max(1, -(-rows.count() // QUERY_BLOCK))
    blocked = rows.groupBy(
        "dim",
        F.pmod(F.xxhash64("query_id", "name"), F.lit(blocks)).alias("block"),
    ).agg(F.collect_list(F.struct("query_id", "name", "v")).alias("queries"))
    names = index.select("dim", "shard")
    each = blocked.join(names, "dim")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        row = {name: rows.column(name).combine_chunks()[0] for name in rows.column_names}
        dim, scale = row["dim"].as_py(), row["scale"].as_py()
        vectors = np.frombuffer(row["vectors"].as_py(), np.float64).reshape(-1, dim)
        graph = Graph.unpack(vectors / scale, row["sizes"].as_py(), row["neighbours"].as_py(), row["links"].as_py())
        ids, asked = np.asarray(row["ids"].values), row["queries"].values
        own = matrix(asked.field("v"), dim)
        found = graph.search(own / scale, max(beam, k))
        out: list[list] = [[], [], []]
        for at, nodes in enumerate(found):
            nodes = nodes[nodes >= 0]
            score = np.sqrt(((vectors[nodes] - own[at]) ** 2).sum(1))
            best = np.lexsort((ids[nodes], score))[:k]
            out[0].append(np.full(len(best), at))
            out[1].append(ids[nodes][best])
            out[2].append(score[best])
        at = np.concatenate(out[0])
        return pa.table(
            {
                "query_id": asked.field("query_id").take(pa.array(at)),
                "name": asked.field("name").take(pa.array(at)),
                "class_id": np.concatenate(out[1]),
                "score": np.concatenate(out[2]),
            }
        )

    # A graph goes to a task with one block of queries at a time.
    joined = index.join(each, ["dim", "shard"])
    return joined.groupBy("dim", "shard", "block").applyInArrow(
        run,
        "query_id bigint, name bigint, class_id bigint, score double",
    )


def nearest(
    rows: DataFrame,
    queries_where,
    k: int = 10,
    vector: str = "embedding",
    shard_rows: int | None = None,
    beam: int = BEAM,
) -> DataFrame:
    """query_id, rank, vec_id, score. queries_where: the condition on rows that are asked for."""
    members = materialize(classes(rows, vector, k), "classes")
    index = build_index(members, shard_rows)
    # A query's own vector stands for itself, whatever its place in its class.
    asked = valid(rows.where(queries_where), vector).select(
        F.col("vec_id").alias("query_id"),
        F.xxhash64("v").alias("name"),
        "v",
    ).dropDuplicates(["query_id", "name"])
    found = materialize(search_index(index, asked, k + 1, beam), "found")
    best = Window.partitionBy("query_id", "name").orderBy("score", "class_id")
    top = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    ranked = top.join(
        members.select("class_id", "vec_id"),
        "class_id",
    ).where("vec_id <> query_id").groupBy("query_id", "name", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id", "name").orderBy("score", "vec_id")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
