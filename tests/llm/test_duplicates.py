"""Near duplicates and repeated lines against brute force."""

import re

import numpy as np
import pytest

from sonorel.llm import components as stars
from sonorel.llm import jaccard, line_dedup
from sonorel.llm.common import materialize
from sonorel.llm.shingles import shingle_sets


def shingles(text):
    w = [
        "".join(
            chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x
        ) for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")
    ]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(items):
    """doc_id -> smallest doc_id that links reach."""
    ids = sorted(items)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and items[a] and items[b]:
                shared = len(items[a] & items[b])
                if 100 * shared >= 75 * (len(items[a]) + len(items[b]) - shared):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_shingles_equal_plain_python(texts):
    for text, own in zip(texts, shingle_sets(texts)):
        assert len(own) == len(shingles(text))
    a, b = shingle_sets(["one two THREE four five six", "one  two three\nfour five six seven"])
    assert len(np.intersect1d(a, b)) == 2


@pytest.mark.parametrize("region,common", [(2000, 32), (3, 2)])
def test_components_equal_brute_force(docs, texts, monkeypatch, region, common):
    monkeypatch.setattr(jaccard, "REGION", region)
    monkeypatch.setattr(jaccard, "COMMON", common)
    want = classes({i: shingles(t) for i, t in enumerate(texts)})
    rows = jaccard.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_shingles, r.component_id) == (len(shingles(texts[r.doc_id])), want[r.doc_id])


def test_one_document_of_each_group_stays(docs, texts, nothing):
    want = classes({i: shingles(t) for i, t in enumerate(texts)})
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted(i for i, c in want.items() if i == c)
    assert jaccard.near_duplicates(nothing).count() == 0
    assert jaccard.one_of_each(nothing).count() == 0


def test_rows_and_not_ids_go(spark):
    a, b = "a b c d e f g h", "s t u v w x y z"
    rows = [
        (1, a, "x"),
        (5, a, "x"),
        (5, b, "x"),
        (7, b, "x"),
        (None, a, "x"),
        (None, "q w e r t y", "x"),
        (1, a, "x"),
        (9, "", "x"),
        (9, "", "x"),
        (None, "q w e r t y", "x"),
        (None, None, "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, `a``b` string")
    kept = sorted(((r.doc_id or 0, r.text) for r in jaccard.one_of_each(df).collect()), key=str)
    assert kept == sorted([(1, a), (5, b), (0, "q w e r t y"), (9, ""), (9, ""), (0, None)], key=str)


@pytest.mark.parametrize("leaf,pivots", [(24, 6), (2, 3)])
def test_cells_within_cells_miss_no_link(monkeypatch, leaf, pivots):
    """Families of sets about random centres, some of which run into one another."""
    import random

    monkeypatch.setattr(jaccard, "LEAF", leaf)
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    rnd = random.Random(8)
    for _ in range(12):
        sets = [set(rnd.sample(range(400), rnd.randint(5, 60))) for _ in range(6)]
        while len(sets) < 150:
            own = set(rnd.choice(sets))
            own ^= set(rnd.sample(range(400), rnd.randint(0, 6)))
            sets.append(own or {1})
        want = classes(dict(enumerate(sets)))
        asked = np.array([rnd.random() < rnd.choice([0.3, 1]) for _ in sets])
        asked = asked if rnd.random() < 0.5 else np.ones(len(sets), bool)
        if not asked.any():
            continue
        region = jaccard.Region([np.array(sorted(s), np.uint64) for s in sets])
        label = np.arange(len(sets))
        found = region.links(int(asked.argmax()), asked, label)
        root = {i: i for i in want}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i, j in found:
            assert 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
            root[find(i)] = find(j)
        for i in range(len(sets)):
            for j in range(i):
                if (asked[i] or asked[j]) and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    assert find(i) == find(j)


def test_null_ids_take_the_smallest_known(spark):
    text = "a b c d e f g"
    df = spark.createDataFrame([(None, text), (5, text), (7, text), (None, None)], "doc_id bigint, text string")
    assert sorted(
        (r.doc_id or -1, r.component_id or -1) for r in jaccard.near_duplicates(df).collect()
    ) == [(-1, -1), (-1, 5), (5, 5), (7, 5)]


def repeated(documents, least):
    """Lines in runs of at least so many words that stand, line for line, at an earlier place: every run is looked up."""
    seen, gone = {}, {}
    for doc in sorted(documents):
        mine, gone[doc] = documents[doc], set()
        words = [len(x.split()) for x in mine]
        for i in range(len(mine)):
            for j in range(i + 1, len(mine) + 1):
                first = seen.setdefault(tuple(mine[i:j]), (doc, i))
                if first < (doc, i) and sum(words[i:j]) >= least:
                    gone[doc] |= set(range(i, j))
    return gone


def test_lines_equal_brute_force(spark):
    import random

    rnd = random.Random(9)
    pool = [" ".join(rnd.choice("abcdefghijkl") * 2 for _ in range(rnd.randint(1, 9))) for _ in range(40)] + [""]
    documents = {i: [rnd.choice(pool) for _ in range(rnd.randint(1, 12))] for i in range(40)}
    run = [f"passage {k} of some words here" for k in range(11)]
    for i in (3, 9, 30):
        documents[i][2:2] = run
    documents[35] = list(documents[3])
    # Two runs from different places that overlap by a line; a run within itself; blank lines within and around.
    documents[36] = run[:6] + ["x y z"] + run[5:] + ["", ""]
    documents[37] = ["p q r s"] * 9 + ["", ""] + run + [""] * 3 + run[::-1]
    documents[38] = ["own words here"] + documents[9][:5] + documents[30][3:9] + documents[37][4:]
    df = spark.createDataFrame(
        [(i, "\n".join(x), 1) for i, x in documents.items()],
        "doc_id bigint, text string, `rank` int",
    ).repartition(3)
    for least in (1, 8, 20, 50):
        want = repeated(documents, least)
        for r in line_dedup.dedup_lines(df, least).collect():
            assert {int(x) for x in r.removed_lines.split(",") if x} == want[r.doc_id]
            assert r.text == "\n".join(x for k, x in enumerate(documents[r.doc_id]) if k not in want[r.doc_id])


def test_overlapping_runs_count_their_words_apart(spark):
    one, two = [f"first {k} of the passage" for k in range(4)], [f"second {k} of the passage" for k in range(4)]
    rows = [(1, "\n".join([*one, "bridge"])), (2, "\n".join(["bridge", *two])), (3, "\n".join([*one, "bridge", *two]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(df, 30).collect()} == {1: 0, 2: 0, 3: 0}
    assert {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(df, 21).collect()} == {1: 0, 2: 0, 3: 9}


def test_lines_of_odd_documents(docs, nothing):
    rows = line_dedup.dedup_lines(docs).collect()
    assert len(rows) == docs.count() and {r.text for r in rows if r.n_lines == 0} == {None}
    kept = line_dedup.keep_documents(docs)
    assert kept.columns == docs.columns and kept.where("text is null").count() == docs.where("text is null").count()
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_each_star_is_written_before_the_next_reads_it(spark, monkeypatch):
    plans = []

    def noted(df, label):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return materialize(df, label)

    monkeypatch.setattr(stars, "materialize", noted)
    path = [(i, i + 1) for i in range(10, 30)] + [(30, 12), (40, 41), (42, 41), (5, 5)]
    edges = spark.createDataFrame(path, "a long, b long")
    want = {i: 10 for i in range(11, 31)} | {41: 40, 42: 40}
    found = stars.components(edges)
    assert {r.a: r.b for r in found.collect()} == want and found.count() == len(want)
    assert max(len(re.findall(r"\bJoin\b", p)) for p in plans) == 1
    plans.clear()
    assert {r.a: r.b for r in stars.components(found).collect()} == want
    assert stars.components(found.where("a < 0")).count() == 0
    assert len(plans) == 2
