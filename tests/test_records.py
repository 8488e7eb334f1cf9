"""Frames: reading, selecting, resolving, and the numbers of the seed corpus."""

import pytest
from pyspark.sql import functions as F

from sonorel.operators import calibration as C
from sonorel.operators import frames as R
from sonorel.operators import profile as P
from sonorel.operators import text as X
from sonorel.sources import records


def frames(spark, *lines):
    df = spark.createDataFrame(list(enumerate(lines)), "pos bigint, value string")
    return records.parse_frames(df)


def test_frames_round_trip_with_unknown_fields(spark, tmp_path):
    line = '{"v":1,"kind":"text","id":"a","data":"x","later":[1]}'
    f = frames(spark, line, "", '{"v":1,"kind":"audio","id":"b","lineage":["a"],"hash":"h"}')
    records.write_frames(f, str(tmp_path / "out"))
    back = records.read_frames(spark, str(tmp_path / "out"))
    assert sorted(r.id for r in back.collect()) == ["a", "b"] and line in [r.raw for r in back.collect()]
    with pytest.raises(Exception, match="not a frame"):
        frames(spark, "[1]").collect()


def test_last_wins_by_seq_only_where_all_have_one(spark):
    f = frames(spark, '{"id":"a","role":"r","seq":2}', '{"id":"b","role":"r","seq":1}')
    assert R.select(f, role="r").first().id == "a"
    assert R.select(f.withColumn("seq", F.when(F.col("id") == "a", F.col("seq")))).first().id == "b"
    with pytest.raises(Exception, match="strict"):
        R.select(f, mode="strict").collect()
    assert R.select(f, role="none").count() == 0


def test_resolution_tells_the_root_cause(spark):
    f = frames(
        spark,
        '{"id":"src","kind":"audio","role":"source","hash":"h"}',
        '{"id":"e","kind":"error","data":{"code":"decode_failed","message":"bad","of":"src"}}',
        '{"id":"w","kind":"audio","role":"wet","of":"src"}',
    )
    assert R.resolve_audio(f, "source").first().id == "src"
    wet = R.resolve_audio(f, "wet").first()
    assert (wet.id, wet.code, wet.message) == (None, "decode_failed", "bad")
    assert R.resolve_audio(f.where("kind <> 'error'"), "none").first().code == "not_found"


def test_conformance(spark):
    f = frames(
        spark,
        '{"id":"a","kind":"text"}',
        '{"id":"b","kind":"text","of":"c","lineage":["a","x"]}',
        '{"id":"c","kind":"text"}',
        '{"id":"a","kind":"audio"}',
    )
    assert {(r.child, r.parent) for r in R.dangling(f).collect()} == {("b", "x")}
    assert {(r.child, r.parent) for r in R.out_of_order(f).collect()} == {("b", "c")}
    assert [r.id for r in R.collisions(f).collect()] == ["a"]


# The seed corpus (profile: median 0, deviation 1, 30 values, linear).
SEED = [
    (0.2, -0.3, "keep"),
    (-0.5, 0.4, "keep"),
    (1.0, 0.2, "keep"),
    (0.3, 0.1, "cut"),
    (0.1, 2.4, "listen"),
    (2.6, 0.0, "keep"),
    (0.0, -3.0, "cut"),
    (0.1, 5.0, "cut"),
    (-4.5, 0.2, "cut"),
    (4.0, 0.1, "listen"),
]


def test_seed_corpus(spark):
    rows = [(f"s{i}", "r", h, "v1") for i, (_, _, h) in enumerate(SEED)] + [("n", "r", None, "v1"), ("m", "other", "keep", "v0")]
    entries = spark.createDataFrame(rows, "id string, role string, human_verdict string, feature_schema string")
    features = spark.createDataFrame(
        [(f"s{i}", k, v) for i, (a, b, _) in enumerate(SEED) for k, v in (("a", a), ("b", b))],
        "id string, key string, value double",
    )
    profile = spark.createDataFrame(
        [("r", k, 0.0, 1.0, 30, "linear") for k in "ab"],
        "role string, key string, median double, mad double, n bigint, domain string",
    )
    scored = C.score_entries(entries, features, profile, "v1")
    found = C.accuracies(scored).first()
    assert (found.auto_keep, found.auto_cut, found.overall, found.n) == (0.75, 0.666667, 0.6, 10) and not found.meets_target
    assert {r.skipped for r in scored.collect()} == {None, "no_human_verdict", "no_profile"}
    assert [r.id for r in scored.where("stale").collect()] == ["m"]


def test_bracketed_quantiles_are_exact(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("role"),
        F.lit("x").alias("key"),
        (F.pmod(F.hash("id"), F.lit(977)) / 7.0 - 20).alias("value"),
    )
    near = lambda d: {
        r.role: tuple(r[1:]) for r in d.select("role", "median", "mad", "p10", "p90", "n", "domain").collect()
    }
    assert near(P.build_profile(df)) == near(P.build_profile(df, most_in_task=0))


def test_low_confidence_asks_to_listen(spark):
    rows = spark.createDataFrame(
        [(None, 0, 0), (0.5, 1, 5), (2.5, 1, 5), (9.0, 2, 50), (1.9, 2, 50)],
        "max_abs double, n_axes int, min_n int",
    ).withColumn("distance", F.col("max_abs"))
    assert [r.decision for r in P.judge(rows).collect()] == ["listen", "listen", "alter", "cut", "keep"]


def test_subtitles_and_patterns(spark):
    cues = spark.createDataFrame(
        [("a", 0.0, 0.0, "hi"), ("a", 3.5, 1.0, "yo"), ("a", 2.0, 1.0, " ")],
        "track string, t double, dur double, label string",
    )
    assert X.subtitle(
        X.cue_lines(cues, ["track"], "srt"),
        ["track"],
        "srt",
    ).first().text == "1\n00:00:00,000 --> 00:00:02,000\nhi\n\n2\n00:00:03,500 --> 00:00:04,500\nyo\n"
    bad = spark.createDataFrame(
        [("t", "s", 99, 1.0, None, None)],
        "track string, source string, step int, velocity double, gain_db double, bars array<int>",
    )
    with pytest.raises(Exception, match="out of range"):
        X.expand_pattern(bad, 1).collect()


def test_hits_have_nudge_and_pitch(spark):
    hits = [
        ("t", "s", 1, 1.0, None, None, -0.5, None, -2.0),
        ("t", "s", 2, 1.0, None, None, 0.25, 0.0, -2.0),
        ("t", "s", 5, 1.0, None, None, -0.125, 7.0, None),
        ("t", "s", 9, 1.0, None, None, None, None, None),
    ]
    names = "track string, source string, step int, velocity double, gain_db double, bars array<int>, nudge double, pitch double, track_pitch double"
    got = X.expand_pattern(spark.createDataFrame(hits, names), 1, swing=0.5).orderBy("step").collect()
    assert [(r.beat, r["at"], r.pitch) for r in got] == [
        (0.0, "1.1.000", -2.0),
        (0.625, "1.1.625", 0.0),
        (0.875, "1.1.875", 7.0),
        (2.0, "1.3.000", 0.0),
    ]


def test_corpus_profile_and_brief_readers(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('# note\n\n{"id":"a","role":"r","human_verdict":"keep","features":{"x":1.5}}\n')
    (tmp_path / "c.json").write_text('[{"id":"b","features":{"x":2}}]')
    assert {
        r.id: r.features["x"] for f in ("c.jsonl", "c.json") for r in records.read_corpus(spark, str(tmp_path / f)).collect()
    } == {"a": 1.5, "b": 2.0}
    (tmp_path / "p.json").write_text('{"k":{"median":1.0,"mad":0.5,"n":30,"domain":"linear"}}')
    assert records.read_profile(spark, str(tmp_path / "p.json")).first().median == 1.0
    (tmp_path / "b.json").write_text('{"a":[1,2],"b":{"min":3,"max":4}}')
    assert {
        r.key: (r.lo, r.hi) for r in records.read_brief(spark, str(tmp_path / "b.json")).collect()
    } == {"a": (1.0, 2.0), "b": (3.0, 4.0)}


def test_reports_and_absent_tools(spark):
    from sonorel.operators import external, report

    f = frames(
        spark,
        '{"id":"a","kind":"audio","hash":"h"}',
        '{"id":"f","kind":"feature","of":"a","data":{"x_db":-3,"m":{"mean":1,"stdev":2},"n":{"k":4}}}',
        '{"id":"e","kind":"error","of":"a","data":{"code":"op_failed","message":"no"}}',
    )
    text = report.markdown(report.report_rows(f))
    assert "- x_db: -3 dB" in text and "- m: 1 (±2)" in text and "- n.k: 4" in text and "op_failed: no" in text
    assert report.placed(text) == "inline"
    absent = external.run("stems", f).first()
    assert absent.of == "a" and '"unsupported"' in absent.data
    rows = spark.createDataFrame([(1, b"abc")], "id int, content binary")
    assert external.through(rows, ["tr", "a-z", "A-Z"]).first().content == b"ABC"
    assert external.through(rows, ["no-such-program"]).first().error.startswith("unsupported")
