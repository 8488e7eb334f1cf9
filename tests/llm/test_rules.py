"""Quality rules and personal data."""

import hashlib
import re

import duckdb
import pytest
import regex
from pyspark.sql import functions as F

from sonorel.llm import pii, quality

WORD, HEAD, TAIL = (regex.compile(x) for x in (r"[\p{L}\p{M}']+", r"^[\p{L}\p{M}']+", r"[\p{L}\p{M}']+$"))
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base(text):
    out = []
    for k, (name, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15,
            }[name]()
            if ok:
                out.append((m.start(), k, m.end(), name))
    return sorted(out)


def test_base_spans_equal_the_patterns(spark, texts):
    import random

    rnd = random.Random(4)
    odd = ["".join(rnd.choice("a1@..-+ ()_%Z9é😀\n") for _ in range(rnd.randint(1, 60))) for _ in range(1500)]
    odd += ["x" + "".join(rnd.choice("0123456789 -.+") for _ in range(rnd.randint(10, 60))) for _ in range(1500)]
    rows = list(enumerate([*texts, *odd]))
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = base(rows[r.doc_id][1])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, b, n in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(n == k for *_, n in want) for k in PATTERNS]


def test_terms_that_reveal_an_entity(spark):
    plain = "the of and to in that is was for on with as by at from".split()
    rows = [(i, f"{' '.join(plain)} marigold joe@a.example wrote {' '.join(plain)} {' '.join(plain[::-1])}") for i in range(6)]
    rows += [(100 + i, " ".join(plain * 4)) for i in range(200)]
    rows += [(500, f"{' '.join(plain)} marigold {' '.join(plain)}")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    words = {
        rows[0][1][int(a) : int(b)] for k, a, b in (s.split(":") for s in got[0].spans.split(",")) if k in ("general", "remove")
    }
    assert words == {"marigold", "wrote"}
    assert all(got[i].spans == "" for i in range(100, 300))
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "joe@a.example" not in clean[0] and "marigold" not in clean[0] and "<EMAIL>" in clean[0]
    # A word that reveals goes in documents without the entity as well.
    assert "marigold" not in clean[500] and clean[100] == rows[6][1]


def test_terms_are_placed_where_the_entity_is_absent(spark):
    plain = "the of and to in that is was for on with as by at from".split()
    rows = [(i, f"{' '.join(plain)} marigold joe@a.example wrote {' '.join(plain)} {' '.join(plain[::-1])}") for i in range(20)]
    rows += [(100 + i, " ".join(plain * 4)) for i in range(200)]
    rows += [(500, f"{' '.join(plain)} Marigold {' '.join(plain)}")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    kind, a, b = got[500].spans.split(":")
    assert kind in ("general", "remove") and rows[-1][1][int(a) : int(b)] == "Marigold" and got[500].n_terms == 1
    assert all(got[i].spans == "" for i in range(100, 300))
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "Marigold" not in clean[500] and clean[100] == rows[20][1]


def test_a_bound_decides_and_no_number_of_documents(spark):
    plain = "the of and to in that is was for on with as by at from".split()
    one = lambda word, who: f"{' '.join(plain)} {word} {who}@a.example {' '.join(plain)}"
    rows = [
        (0, one("marigold", "joe")),
        (1, one("marigold", "joe")),
        (2, one("tulip", "ann")),
        (3, one("clover", "ian")),
        (4, one("clover", "ian")),
    ]
    rows += [(100 + i, " ".join(plain * 4) + (" clover" if i < 6 else "")) for i in range(400)]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    terms = {
        i: [
            rows[i][1][int(a) : int(b)] for k, a, b in (
                s.split(":") for s in got[i].spans.split(",")
            ) if k in ("general", "remove")
        ] for i in range(5)
    }
    # Of 10 bits: marigold 2 of 2, at least 0.55; tulip 1 of 1, at least 0.38; clover 2 of 8.
    assert terms == {0: ["marigold"], 1: ["marigold"], 2: [], 3: [], 4: []}
    assert all(got[i].spans == "" for i in range(100, 500))


def plain_disclosures(rows):
    """term -> (largest share, entity), and the sums it comes from, word by word."""
    import math
    from collections import Counter

    words = lambda t: WORD.findall(t.lower())
    counts, size, joint = Counter(), Counter(), Counter()
    for _, text in rows:
        text = text or ""
        counts.update(words(text))
        for start, kind, end, name in base(text):
            hit, low, high = text[start:end], max(0, start - 160), min(len(text), end + 160)
            before, after = text[low:start], text[end:high]
            if low > 0:
                before = HEAD.sub("", before)
            if high < len(text):
                after = TAIL.sub("", after)
            near = words(before)[-6:] + words(after)[:6]
            digits = re.sub("[^0-9]", "", hit)
            value, group = {
                "email": (hit.lower(), hit.lower().split("@")[-1]),
                "ip": (hit, hit.rpartition(".")[0]),
                "card": (digits, digits[:6]),
                "phone": (digits, digits[:-4]),
            }[name]
            for entity in (f"{name}:{value}", f"{name}-group:{group}"):
                size[entity] += len(near)
                joint.update((entity, w) for w in near)
    total, z = sum(counts.values()), 1.2816

    def share(n_joint, n_term, n_entity):
        p = min(n_joint, n_term) / n_term
        low = (p + z * z / (2 * n_term) - z * math.sqrt(p * (1 - p) / n_term + z * z / (4 * n_term**2))) / (1 + z * z / n_term)
        information = -math.log2(n_entity / total)
        return (math.log2(low) + information) / information

    out = {}
    for (entity, w), n in joint.items():
        if size[entity] < total:
            out.setdefault(w, []).append((share(n, counts[w], size[entity]), entity))
    found = {w: max(x) for w, x in out.items() if max(x)[0] >= 0.9}
    labels = {}
    for w, (s, _) in found.items():
        labels[w] = "" if s >= 0.97 else "<WORD>"
        if s < 0.97:
            for k in (2, 4):
                if len(w) <= k:
                    continue
                mine = [e for x, e in out[w] if x >= 0.9]
                own = [v for v in counts if len(v) > k and v[:k] == w[:k]]
                worst = [share(sum(joint[e, v] for v in own), sum(counts[v] for v in own), size[e]) for e in mine]
                if max(worst) < 0.9:
                    labels[w] = w[:k] + "*"
    return found, labels


def test_terms_equal_plain_python(spark):
    import random

    rnd = random.Random(6)
    names = ["marigold", "maritime", "tulip", "tundra", "oz", "clover"]
    vocabulary = [
        "".join(rnd.choice("abcdefgilmrt") for _ in range(rnd.randint(2, 7))) for _ in range(300)
    ] + ["heats", "heated", "brine", "bread", "it's", "élan"]
    some = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    often = ["heather", "brambles qx", "oak", "zzyzx", "heathen", "xy"]
    people = ["joe@a.example", "ann@a.example", "10.1.2.3", "10.1.2.77", "+1 (555) 123-4567", "4111 1111 1111 1111"]
    rows = []
    for i in range(120):
        k = rnd.randrange(6)
        rows.append(
            (i, f"{some(rnd.randint(0, 40))} {often[k]} {names[k]} {people[k]} {some(2)} {people[k]} {names[k - 1] if rnd.random() < 0.1 else ''} {some(20)}")
        )
    # Words that others use too, now and then; the class of one is common, and of another not.
    rows += [
        (200 + i, some(60) + (f" {often[i // 25 % 6].title()}" if i % 25 < 2 else "")) for i in range(300)
    ] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want, labels = plain_disclosures(rows)
    assert {"", "<WORD>", "heat*", "br*"} <= set(labels.values())
    got = {r.term: r for r in pii.disclosures(pii.found_in(df, [])).collect()}
    assert set(got) == set(want)
    for term, (share, entity) in want.items():
        assert abs(got[term].share - share) < 1e-9 and got[term].label == labels[term]
        assert got[term].entity == entity or abs(share - want[term][0]) < 1e-9
    for r in pii.personal_data(df).collect():
        text = dict(rows)[r.doc_id] or ""
        plain = base(text)
        more = [
            (
                m.start(),
                4 if want[m[0].lower()][0] < 0.97 else 5,
                m.end(),
            ) for m in WORD.finditer(text) if m[0].lower() in want and not any(m.start() < e and s < m.end() for s, _, e, _ in plain)
        ]
        every = sorted([(a, k, b) for a, k, b, _ in plain] + more)
        assert r.spans == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in every) and r.n_terms == len(more)


def test_a_text_of_many_spans(spark):
    import time

    text = " ".join(f"word{i} joe{i}@mail.example" for i in range(16_000))
    df = spark.createDataFrame([(1, text), (2, "nothing")], "doc_id bigint, text string")
    pii.personal_data(df.where("doc_id = 2")).collect()
    began = time.perf_counter()
    spans = df.select(pii.base_spans(F.col("text")).alias("s")).collect()
    took = time.perf_counter() - began
    assert [(s.start, s.end) for s in spans[0].s] == [(a, b) for a, _, b, _ in base(text)]
    assert took < 20
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "@" not in clean[1] and clean[1].count("<EMAIL>") == 16_000 and clean[2] == "nothing"


def test_names_with_odd_characters(spark):
    df = spark.createDataFrame([(1, "a@b.c x", 5, "l", "s")], ["doc_id", "text", "a`b.c", "_null", "_null_"])
    assert [tuple(r) for r in pii.sanitise(df).collect()] == [(1, "<EMAIL> x", 5, "l", "s")]


def test_sanitise_keeps_all_else(docs, nothing):
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    before, after = ({(r.doc_id, r.words, r.row, r.nid) for r in d.collect()} for d in (docs, out))
    assert before == after and out.where("text is null").count() == docs.where("text is null").count()
    assert pii.personal_data(nothing).count() == 0


def test_quality_equals_its_sql(docs, texts):
    import pandas as pd

    con = duckdb.connect()
    con.register(
        "given",
        pd.DataFrame(
            [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()],
            columns=["doc_id", "text", "lang", "source"],
        ),
    )
    con.execute("CREATE TABLE documents AS SELECT * FROM given")
    names = [d[0] for d in con.execute(quality.ORACLE_SQL).description]
    want = sorted(map(tuple, con.execute(quality.ORACLE_SQL).fetchall()))
    assert want == sorted(tuple(r) for r in quality.quality(docs).select(*names).collect())


def test_measures_by_hand(spark):
    eight = "a b c d e f g h"
    text = f"{eight} {eight}\nx # y\nx # y\n \n "
    r = quality.quality(
        spark.createDataFrame([(1, text, "en", "s")], "doc_id bigint, text string, lang string, source string")
    ).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (22, 22, 2, 1, 16, True)


def test_junk_goes_and_clean_documents_stay(spark):
    good = [(i, " ".join(f"word{(i * 7 + k * k) % 97}" for k in range(60)), "en", "s") for i in range(200)]
    junk = [(1000 + i, " ".join(f"w#{k}$$$ %%%&&&" for k in range(60)), "en", "s") for i in range(10)]
    df = spark.createDataFrame(good + junk, "doc_id bigint, text string, lang string, source string")
    assert {r.doc_id for r in quality.filter_documents(df).collect()} == set(range(200))


def test_filter_keeps_columns(docs, nothing):
    assert quality.filter_documents(docs).columns == docs.columns
    assert quality.quality(nothing).count() == 0


@pytest.mark.parametrize("v,low", [(0, 0), (127, 127), (128, 128), (129, 128), (1000, 1000), (1001, 1000), (5000, 4992)])
def test_buckets_keep_leading_bits(spark, v, low):
    from pyspark.sql import functions as F

    assert spark.range(1).select(quality.bucket(F.lit(v).cast("long"))).first()[0] == low
