"""Vectors: placement, a normalised index, and cosine search."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonorel.operators.series import doubles, total
from sonorel.schema import MAX_INLINE_DIM
from sonorel.storage import materialize

#: Queries that meet the index together.
QUERY_BLOCK = 2048


def placement(v: Column) -> Column:
    return F.when(F.size(v) <= MAX_INLINE_DIM, "inline").otherwise("blob")


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    d = doubles(v)
    norm = F.sqrt(total(F.transform(d, lambda x: x * x)))
    return F.when(norm > 0, F.transform(d, lambda x: x / norm)).otherwise(d)


def build_index(vectors: DataFrame) -> DataFrame:
    """id, unit: a flat inner-product index."""
    return vectors.select("id", unit(F.col("vector")).alias("unit"))


def index_summary(index: DataFrame, name: str) -> DataFrame:
    return index.agg(F.lit(name).alias("name"), F.count("*").alias("count"), F.max(F.size("unit")).alias("dim"))


def query_index(index: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, id, score: the k most similar. queries (id, vector) is a stated set. It meets the index in blocks:
    a block's vectors go to all tasks as one matrix, each task multiplies its rows with it, and keeps k a query before
    anything is shuffled. So neither a pair of rows nor more than a block of queries is ever held in a table."""
    asked = materialize(queries.select(F.col("id").alias("query_id"), unit(F.col("vector")).alias("q")), "queries")
    blocks = max(1, -(-asked.count() // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    found = None
    for n in range(blocks):
        own = asked.where(F.col("block") == n).toArrow()
        part = index.select("id", "unit").mapInArrow(
            _nearest_of(own["query_id"], own["q"], k),
            "query_id bigint, id bigint, score double",
        )
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _nearest_of(names: pa.ChunkedArray, vectors: pa.ChunkedArray, k: int):
    """The k best of each batch of rows for each query, of the query's length."""
    queries: dict[int, tuple[list, list]] = {}
    for name, v in zip(names.to_pylist(), vectors.to_pylist()):
        if v is not None:
            own = queries.setdefault(len(v), ([], []))
            own[0].append(name)
            own[1].append(v)
    matrices = {dim: (np.array(ids, np.int64), np.array(rows)) for dim, (ids, rows) in queries.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.list_value_length(batch.column(1)), -1))
            for dim, (ids, rows) in matrices.items():
                at = np.flatnonzero(sizes == dim)
                own = batch.take(pa.array(at))
                if not len(at):
                    continue
                key = own.column(0).to_numpy()
                score = np.round(rows @ np.asarray(own.column(1).flatten()).reshape(-1, dim).T, 6) + 0.0
                order = np.lexsort((np.broadcast_to(key, score.shape), -score), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(ids, order.shape[1])),
                        pa.array(key[order].ravel()),
                        pa.array(np.take_along_axis(score, order, 1).ravel()),
                    ],
                    ["query_id", "id", "score"],
                )

    return run


def read_vectors(frames: DataFrame, blobs: DataFrame | None = None) -> DataFrame:
    """id, vector, error, of vector frames: inline data, or the array in a blob's .npy file. blobs: hash, content."""
    own = frames.where("kind = 'vector'").select("id", "hash", F.from_json("data", "array<float>").alias("vector"))
    if blobs is None:
        blobs = frames.sparkSession.createDataFrame([], "hash string, content binary")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, wrong = [], []
            for inline, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                value, bad = inline, None
                if value is None:
                    try:
                        value = np.load(io.BytesIO(raw), allow_pickle=False).astype(np.float32).ravel() if raw is not None else None
                        bad = "not_found: no such blob" if raw is None else None
                    except ValueError as e:
                        bad = f"decode_failed: {e}"
                found.append(value)
                wrong.append(bad)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.float32())), pa.array(wrong, pa.string())],
                ["id", "vector", "error"],
            )

    joined = own.join(blobs.select("hash", "content"), "hash", "left").select("id", "vector", "content")
    return joined.mapInArrow(load, "id string, vector array<float>, error string")


def npy_blobs(vectors: DataFrame) -> DataFrame:
    """hash, content: vectors (hash, vector) as .npy files of single precision."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                file = io.BytesIO()
                np.save(file, np.asarray(v, np.float32), allow_pickle=False)
                out.append(file.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["hash", "content"])

    return vectors.select("hash", "vector").mapInArrow(save, "hash string, content binary")


def upsert(registry: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """The registry with entries of the same key replaced."""
    return registry.join(new.select(key), key, "left_anti").unionByName(new)


def remove(registry: DataFrame, keys: list[str], key: str = "name") -> DataFrame:
    return registry.where(~F.col(key).isin(keys))
