"""Sharding, archives and nearest neighbours."""

import hashlib
import zlib

import numpy as np
import pytest

from sonorel.llm import ann, sharding, warc


def test_shards_are_near_equal_and_places_gapless(docs, nothing):
    rows = sharding.shard_documents(docs, 4).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == docs.count()
    held, places = {}, {}
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        held[r.shard] = held.get(r.shard, 0) + r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert max(held.values()) - min(held.values()) <= max(r.size for r in rows)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sharding.shard_documents(nothing, 4).count() == 0


def test_rebalancing_edits_the_map(spark, tmp_path):
    rng = np.random.default_rng(1)
    size = rng.integers(1, 1000, 4096).tolist()
    old = sharding.first_map(size, 8)
    new = sharding.rebalance(old, size, 9)
    held = [sum(s for s, m in zip(size, new) if m == k) for k in range(9)]
    assert max(held) - min(held) <= 0.02 * sum(held) / 9
    assert all(b == 8 for a, b in zip(old, new) if a != b)
    fewer = sharding.rebalance(new, size, 8)
    assert set(fewer) == set(range(8)) and all(a == b for a, b in zip(new, fewer) if a < 8)
    path = f"file://{tmp_path}/map"
    sharding.store_map(spark, path, 1, old)
    sharding.store_map(spark, path, 2, new)
    assert sharding.load_map(spark, path) == new and sharding.load_map(spark, path, 1) == old


def test_repeated_rows_fill_no_shard(spark):
    rows = [(1, "the same text")] * 20_000 + [(i, f"text {i}") for i in range(2, 500)] + [(None, None)] * 3000
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = sharding.shard_documents(df, 40).collect()
    assert sorted((r.doc_id or 0, r.size) for r in got) == sorted((i or 0, len(t or "") + 16) for i, t in rows)
    held, places = [0] * 40, {}
    for r in got:
        held[r.shard] += r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert max(held) - min(held) <= 0.02 * max(held)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    again = {(r.doc_id, r.text_crc32, r.vslot) for r in sharding.shard_documents(df.repartition(3), 40).collect()}
    assert again == {(r.doc_id, r.text_crc32, r.vslot) for r in got}


def test_versions_of_a_map_never_change(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    sharding.store_map(spark, path, 1, [0, 1, 0])
    with pytest.raises(Exception, match="already exists"):
        sharding.store_map(spark, path, 1, [1, 1, 1])
    assert sharding.load_map(spark, path, 1) == [0, 1, 0]
    with pytest.raises(LookupError):
        sharding.load_map(spark, path, 7)


def test_documents_follow_the_stored_map(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(3000)], "doc_id bigint, text string")
    path = f"file://{tmp_path}/map"
    first = {r.doc_id: (r.vslot, r.shard) for r in sharding.shard_documents(df, 8, map_path=path).collect()}
    assert {i: (r.vslot, r.shard) for r in sharding.shard_documents(df, 3, map_path=path).collect() for i in [r.doc_id]} == first
    new = sharding.rebalance_stored(df, 9, path, 1)
    assert sharding.load_map(spark, path) == new != sharding.load_map(spark, path, 1)
    moved = {r.doc_id: r.shard for r in sharding.shard_documents(df, 9, map_path=path, version=2).collect()}
    assert all(moved[i] == new[slot] for i, (slot, _) in first.items())
    held = [sum(i % 50 + 16 for i, s in moved.items() if s == k) for k in range(9)]
    assert max(held) - min(held) <= 0.02 * max(held)
    assert sum(i % 50 + 16 for i, (_, shard) in first.items() if moved[i] != shard) <= 0.13 * sum(held)


def pages(spark):
    big = "<p>é</p>" * 40
    rows = [
        (1, "http://a/é x", big),
        (2, None, big),
        (9, "u", "small"),
        (8, "u", "small"),
        (5, "u", None),
        (None, "u", big),
        (3, "http://b\r\nX: y", "z" * 100),
        (4, "u", "z" * 100),
        (4, "u", "z" * 100),
    ]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)


def test_archives_give_back_every_page(spark, tmp_path):
    for compress in (False, True):
        path = f"file://{tmp_path}/{compress}"
        warc.write_warc(pages(spark), path, compress=compress)
        got = warc.read_warc(spark, path).collect()
        want = [(r.page_id, (r.html or "").encode()) for r in pages(spark).collect()]
        key = lambda x: (x[0] or -1, x[2])
        assert sorted(
            ((r.page_id, r.payload_bytes, r.payload_digest) for r in got),
            key=key,
        ) == sorted(((i, len(p), hashlib.sha256(p).hexdigest()) for i, p in want), key=key)
        refers = {(r.page_id, r.record_type, r.refers_to) for r in got}
        assert {
            (1, "response", None),
            (2, "revisit", 1),
            (None, "revisit", 1),
            (9, "response", None),
            (8, "response", None),
            (3, "response", None),
            (4, "revisit", 3),
        } <= refers
        assert all((r.payload is None) == (r.record_type == "revisit") for r in got)


def test_predicates_are_decided_on_headers(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages(spark), path)
    some = warc.read_warc(spark, path).where("record_type = 'revisit' and page_id in (2, 4, 9)")
    assert sorted(r.page_id for r in some.collect()) == [2, 4, 4]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "record_type" in plan.split("BatchScan")[1] and "Filter (" not in plan.split("BatchScan")[0].replace("isnotnull", "")[-5:]
    heads = warc.read_warc(spark, path, ("response",), payloads=False).collect()
    assert heads and all(r.payload is None and r.payload_bytes is not None for r in heads)
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert [
        type(f) for f in reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("page_id",), 3)])
    ] == [GreaterThan]
    assert all(
        r[1].as_py() == "revisit" for p in reader.partitions() for b in reader.read(p) for r in zip(b.column(0), b.column(1))
    )


def test_empty_archives(spark, tmp_path):
    warc.write_warc(pages(spark).where('false'), f"file://{tmp_path}/e")
    assert warc.read_warc(spark, f"file://{tmp_path}/e").count() == 0


def test_neighbours_are_found_and_scored_exactly(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(1500, 16)).astype(np.float32)
    v[700:900] = v[3]
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)] + [
        (5000, None, 1),
        (5100, [0.0] * 16, 1),
        (5200, [float("nan")] * 16, 1),
        (5300, [None] + [1.0] * 15, 1),
        (None, v[0].tolist(), 1),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, `shard` int").repartition(4)
    got = {}
    for r in ann.nearest(df, "vec_id % 100 = 0", 10, shard_rows=300).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 100))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(1))
        best = sorted((x, i) for i, x in enumerate(d) if i != q)[:10]
        found.sort()
        assert [n for n, *_ in found] == list(range(1, 11))
        assert all(abs(s - d[i]) < 1e-12 for _, i, s in found)
        hits += len({i for _, i in best} & {i for _, i, _ in found})
    assert hits >= 0.9 * 10 * len(got)
    assert [i for _, i, _ in got[700]] == [3, *range(701, 710)]


def recall(spark, v, shard_rows=None):
    df = spark.createDataFrame(
        [(i, x.tolist()) for i, x in enumerate(v)],
        "vec_id bigint, embedding array<double>",
    ).repartition(4)
    hits = n = 0
    found = {}
    for r in ann.nearest(df, "vec_id % 100 = 0", 10, shard_rows=shard_rows).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
        assert abs(r.score - np.sqrt(((v[r.query_id] - v[r.vec_id]) ** 2).sum())) <= 1e-15 * r.score
    for q, own in found.items():
        d = ((v - v[q]) ** 2).sum(1)
        d[q] = np.inf
        hits, n = hits + len(own & set(np.argsort(d)[:10].tolist())), n + 10
    assert len(found) == -(-len(v) // 100)
    return hits / n


def test_recall_over_many_shards_and_in_a_large_one(spark):
    """Directions without clusters, the hardest kind, as doubles that single precision can't hold."""
    v = np.random.default_rng(2).normal(size=(6000, 48))
    v /= np.linalg.norm(v, axis=1)[:, None]
    assert recall(spark, v, 500) >= 0.97
    assert recall(spark, v * 1e30) >= 0.95


def test_graphs_link_what_is_near():
    from sonorel.llm.hnsw import Graph

    rng = np.random.default_rng(5)
    for n in (1, 2, 17, 700, 3000):
        v = rng.normal(size=(n, 8)).astype(np.float32)
        graph, order = Graph.build(v)
        assert sorted(order.tolist()) == list(range(n))
        for level, flat in enumerate(graph.levels):
            assert flat.shape[1] == (16 if level else 32) and flat.max() < max(1, len(flat))
            rows = [set(r[r >= 0].tolist()) for r in flat]
            assert all(i not in own and len(own) == (r >= 0).sum() for i, (own, r) in enumerate(zip(rows, flat)))
        again = Graph.unpack(graph.vectors, graph.pack()["sizes"], graph.pack()["neighbours"], 16)
        found = again.search(v[order][:50], 64)
        assert (found[:, 0] >= 0).all() and all(i in row for i, row in enumerate(found.tolist()))
        assert np.array_equal(found, graph.search(v[order][:50], 64))


def test_ids_that_repeat_have_a_ranking_for_each_vector(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 2.0]), (2, [1.0, 1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), "vec_id = 0", 10).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == sorted([(1, 1, 1.0), (2, 2, 1.0), (1, 2, 1.0), (2, 1, 5**0.5)])


def test_few_or_no_vectors(spark):
    kind = "vec_id bigint, embedding array<float>"
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0, 3.0])], kind)
    assert [(r.query_id, r.vec_id) for r in ann.nearest(two, "vec_id = 0", 10).collect()] == [(0, 1)]
    assert ann.nearest(spark.createDataFrame([], kind), "vec_id % 100 = 0").count() == 0
