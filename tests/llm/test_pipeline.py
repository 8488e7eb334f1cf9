"""The pipeline's stages, each against a plain version on what the one before kept."""

import zlib

import corpus_pipeline
import duckdb
import numpy as np
import pandas as pd
from test_duplicates import classes, repeated, shingles
from test_rules import WORD, base, plain_disclosures
from tokenizers import Tokenizer

from sonorel.llm import pii, quality, queries
from sonorel.llm.common import materialize


def by_rules(rows):
    con = duckdb.connect()
    con.register(
        "given",
        pd.DataFrame([(i, r.text, r.lang, r.source) for i, r in enumerate(rows)], columns=["doc_id", "text", "lang", "source"]),
    )
    con.execute("CREATE TABLE documents AS SELECT * FROM given")
    kept = dict(con.execute(f"SELECT doc_id, kept FROM ({quality.ORACLE_SQL})").fetchall())
    return [r for i, r in enumerate(rows) if kept[i]]


def by_lines(rows):
    gone = repeated({(r.doc_id, r.text): r.text.split("\n") for r in rows}, 50)
    out = []
    for r in rows:
        cut = gone[r.doc_id, r.text]
        text = "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in cut)
        if not cut or text:
            out.append((r.doc_id, text))
    return out


def by_company(rows):
    """One row of each group: of equal ids and texts the first."""
    rows = sorted({(r.doc_id, r.text) for r in rows})
    group = classes({i: shingles(t) for i, (_, t) in enumerate(rows)})
    return [row for i, row in enumerate(rows) if group[i] == i]


def by_terms(rows):
    found, labels = plain_disclosures([(r.doc_id, r.text) for r in rows])
    out = []
    for r in rows:
        plain = base(r.text)
        marks = [(a, k, b, pii.LABELS[k]) for a, k, b, _ in plain]
        for m in WORD.finditer(r.text):
            word = m[0].lower()
            if word in found and not any(m.start() < e and s < m.end() for s, _, e, _ in plain):
                marks.append((m.start(), 5 if found[word][0] >= 0.97 else 4, m.end(), labels[word]))
        text, at = "", 0
        for a, _, b, label in sorted(marks):
            if a >= at:
                text += r.text[at:a] + label
            at = max(at, b)
        out.append((r.doc_id, text + r.text[at:]))
    return out


PLAIN = {
    "quality_rules": lambda rows: [(r.doc_id, r.text) for r in by_rules(rows)],
    "line_dedup": by_lines,
    "ngram_jaccard": by_company,
    "pii": by_terms,
}


def test_each_stage_equals_its_plain_version(spark, docs, texts, tokenizer):
    # Besides the fixture's texts: a passage over several lines that recurs, and one text under two ids of which one recurs.
    passage = "\n".join(f"line {k} of a passage that several documents share word for word" for k in range(6))
    more = [(500 + i, texts[i] + "\n" + passage + "\n" + texts[i + 20], "en", "src1", 0, "w", 1, "n") for i in range(4)]
    more += [(500, texts[10], "en", "src1", 0, "w", 1, "n"), (600, texts[10], "de", "src1", 0, "w", 1, "n")]
    now = docs.unionByName(spark.createDataFrame(more, docs.schema))
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES[:-1]] == list(PLAIN)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, now, ""), name)
        assert after.columns == columns
        want = sorted(PLAIN[name](now.collect()), key=str)
        assert sorted(((r.doc_id, r.text) for r in after.collect()), key=str) == want
        assert 0 < len(want) <= now.count()
        now = after
    assert "joe.x@mail.example.org" not in " ".join(r.text or "" for r in now.collect())
    library = Tokenizer.from_file(tokenizer)
    held, sequences = {}, {}
    for r in corpus_pipeline.STAGES[-1][1](spark, now, "").collect():
        held.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want = {}
    for r in now.collect():
        ids = np.array(library.encode(r.text, add_special_tokens=False).ids + [1], "<u4")
        parts = [
            (
                k,
                a,
                len(ids[a : a + 4096]),
                zlib.crc32(ids[a : a + 4096].tobytes()),
            ) for k, a in enumerate(range(0, len(ids), 4096))
        ]
        want.setdefault(r.doc_id, []).extend(parts)
    assert {i: sorted(p) for i, p in held.items()} == {i: sorted(p) for i, p in want.items()}
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096


def test_a_table_without_rows(spark, nothing):
    now = nothing
    for _, stage in corpus_pipeline.STAGES:
        now = materialize(stage(spark, now, ""), "stage")
        assert now.count() == 0


def test_run_on_the_tables(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 50
    assert [k for k in queries.queries()] and set(queries.oracle_sql()) <= set(queries.queries())
