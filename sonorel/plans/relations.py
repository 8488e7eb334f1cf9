"""Frame streams, the blob store and text over the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorel.operators import frames as R
from sonorel.operators import report as RP
from sonorel.operators import text as X
from sonorel.operators import vectors as V
from sonorel.plans.tables import read
from sonorel.sources import records as RD


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as one stream of text frames; each turn follows from the one before."""
    c = read(spark, d, "conversations")
    name = lambda t: F.concat_ws(":", "conv_id", t)
    return R.frame(
        c,
        pos=F.col("conv_id") * 1000 + F.col("turn"),
        kind=F.lit("text"),
        id=name("turn"),
        seq=F.when(F.col("turn") % 3 != 0, F.col("turn")),
        role=F.col("role"),
        of=F.when(F.col("turn") > 0, name(F.col("turn") - 1)),
        data=F.col("text"),
        op=F.col("conv_id").cast("string"),
    )


_TURNS = "t AS (SELECT conv_id * 1000 + turn AS pos, conv_id || ':' || turn AS id, conv_id::VARCHAR AS stream, role, CASE WHEN turn % 3 <> 0 THEN turn END AS seq, CASE WHEN turn > 0 THEN conv_id || ':' || (turn - 1) END AS of, text AS data FROM conversations)"


def _blobs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(
        "doc_id",
        F.sha2(F.col("text").cast("binary"), 256).alias("hash"),
        F.octet_length("text").alias("size"),
        "source",
        "lang",
    )


_BLOBS = "b AS (SELECT doc_id, sha256(text) AS hash, strlen(text) AS size, source, lang FROM documents)"


def scalar_of(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", R.scalar(F.col("props"), "$.k").alias("k"))


def corpus_content_set(spark: SparkSession, d: str) -> DataFrame:
    f = R.frame(_blobs(spark, d), kind=F.when(F.col("lang") == "en", "audio").otherwise("text"), hash=F.col("hash"))
    from sonorel.operators.profile import content_set

    return content_set(f)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(
        F.col("event_id").alias("pos"),
        F.lit(None).cast("bigint").alias("seq"),
        F.col("user_id").alias("stream"),
        F.col("event_type").alias("role"),
        F.lit("feature").alias("kind"),
        "value",
    )


def select_last(spark: SparkSession, d: str) -> DataFrame:
    return R.select(_events(spark, d), role="purchase", by=("stream",)).select("stream", "pos", "value")


def select_all(spark: SparkSession, d: str) -> DataFrame:
    return R.select(_events(spark, d), role="error", mode="all", by=("stream",)).select("stream", "pos", "place.k")


def select_strict_violations(spark: SparkSession, d: str) -> DataFrame:
    return R.matching(_events(spark, d), role="error").groupBy("stream").agg(F.count("*").alias("n")).where("n > 1")


def select_seq_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Streams where every match has a seq go by seq, the others by place."""
    t = _turns(spark, d).withColumnRenamed("op", "stream").withColumn(
        "seq",
        F.when(F.col("stream").cast("long") % 2 == 0, -F.col("pos")).otherwise(F.col("seq")),
    )
    return R.select(t, by=("stream",)).select("stream", "id")


def select_role_fallback(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("kind", F.lit("audio"))
    return R.audio_for_stage(e, role="error", by=("stream",)).groupBy("stream").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("role") == "error").alias("n_role"),
    )


def resolve_hash(spark: SparkSession, d: str) -> DataFrame:
    refs = read(spark, d, "labels").join(_blobs(spark, d), "doc_id").select(F.col("doc_id").alias("frame"), "hash")
    store = _blobs(spark, d).groupBy("hash").agg(F.min("doc_id").alias("path"), F.max("size").alias("size"))
    return refs.join(store, "hash", "left").select("frame", "hash", "path", "size")


def lineage_closure(spark: SparkSession, d: str) -> DataFrame:
    """Turns whose frame before was of the other role's stream: each role's turns are a stream of their own."""
    t = _turns(spark, d)
    return R.dangling(t.where("role = 'assistant'")).unionByName(R.dangling(t.where("role <> 'assistant'")))


def lineage_order(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d).withColumn("pos", F.when(F.col("pos") % 5 == 0, -F.col("pos")).otherwise(F.col("pos")))
    return R.out_of_order(t)


def lineage_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return R.ancestors(R.edges(_turns(spark, d))).groupBy("child").agg(F.count("*").alias("n"))


def passthrough_check(spark: SparkSession, d: str) -> DataFrame:
    return R.dropped(
        read(spark, d, "documents").select(F.col("doc_id").alias("id")),
        read(spark, d, "labels").select(F.col("doc_id").alias("id")),
    )


def id_collisions(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    f = R.frame(docs, id=F.substring("text", 1, 12), kind=F.lit("text"), role=F.col("lang"), data=F.col("text"))
    return R.collisions(f)


def frame_validate(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    f = R.frame(
        docs,
        v=F.when(F.col("doc_id") % 11 != 0, (F.col("doc_id") % 13 == 0).cast("int") + 1),
        kind=F.when(F.col("doc_id") % 3 == 0, "audio").otherwise("text"),
        id=F.when(F.col("doc_id") % 17 != 0, F.col("doc_id").cast("string")),
        hash=F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("blake3:"), F.sha2(F.col("text").cast("binary"), 256))),
        media=F.when(F.col("doc_id") % 5 != 0, "audio/wav"),
        data=F.when(F.col("doc_id") % 4 == 0, F.col("text")),
    )
    return R.validate(f.withColumn("raw", F.col("data"))).select(
        F.array_join("problems", ", ").alias("problems")
    ).groupBy("problems").agg(F.count("*").alias("n"))


def cas_dedup(spark: SparkSession, d: str) -> DataFrame:
    return _blobs(spark, d).groupBy("hash").agg(F.count("*").alias("refs"), F.min("size").alias("size")).where("refs > 1")


def cas_put(spark: SparkSession, d: str) -> DataFrame:
    b = _blobs(spark, d)
    return R.put_blobs(b.where("doc_id % 2 = 0"), b.where("doc_id % 2 = 1")).select("hash", "size")


def gc_summary(spark: SparkSession, d: str) -> DataFrame:
    blobs = _blobs(spark, d).groupBy("hash").agg((F.min("doc_id") * 10).cast("double").alias("age_seconds"))
    refs = _blobs(spark, d).join(read(spark, d, "labels"), "doc_id", "left_semi")
    return R.collect_garbage(blobs, refs, 3600.0).groupBy("fate").agg(F.count("*").alias("n"))


def memo_split(spark: SparkSession, d: str) -> DataFrame:
    docs = _blobs(spark, d).select("doc_id", F.sha2(F.concat_ws("|", F.lit("op@1"), "hash"), 256).alias("memo_key"))
    memo = docs.join(read(spark, d, "labels"), "doc_id", "left_semi").select("memo_key").distinct().withColumn("cached", F.lit(1))
    hit, miss = R.split_by_memo(docs, memo)
    return hit.select("doc_id", F.lit("hit").alias("fate")).union(miss.select("doc_id", F.lit("miss")))


def kind_inventory(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))


def text_snippets(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", X.snippet(F.col("text")).alias("snippet"))


def union_ordered(spark: SparkSession, d: str) -> DataFrame:
    first = read(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.lit("document").alias("kind"))
    more = read(spark, d, "labels").select(F.col("doc_id").alias("pos"), F.lit("label").alias("kind"))
    return R.passthrough(first, more)


def keys_intersect(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id").intersect(read(spark, d, "labels").select("doc_id"))


def refs_except(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id").exceptAll(read(spark, d, "labels").select("doc_id"))


_KEYS = [
    "loudness.integrated_lufs",
    "loudness.true_peak_dbtp",
    "qc.dc_offset_dbfs",
    "envelope.rise_slope_db_ms",
    "envelope.attack_ms_10_90",
    "width.bass.correlation",
    "width.air.side_mid_ratio",
    "spectrum.band.sub",
    "spectrum.oct6.1000",
    "movement.hf_silence_pct",
    "clarity.low_mid_masking_db",
    "rhythm.bpm",
    "qc.lossy.confidence",
    "timbre.hardness",
    "qc.lossy.spectral_cutoff_hz",
    "plain",
]


def _keys(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k,) for k in _KEYS], "key string")


def feature_units(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark).select("key", R.unit_of(F.col("key")).alias("unit"))


def short_keys(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark).select("key", R.short_key(F.col("key")).alias("short"))


def candidate_labels(spark: SparkSession, d: str) -> DataFrame:
    docs = _blobs(spark, d)
    name, source = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("n"), F.col("doc_id"))), F.when(
        F.col("doc_id") % 3 == 1,
        F.concat(F.lit("/a/b/"), F.col("source"), F.lit(".wav")),
    )
    return docs.select(
        "doc_id",
        R.candidate_label(
            name,
            source,
            F.lit("source"),
            F.when(F.col("doc_id") % 2 == 0, F.col("hash")),
            F.col("doc_id"),
        ).alias("label"),
    )


def wet_roles(spark: SparkSession, d: str) -> DataFrame:
    role = F.when(
        F.col("event_id") % 4 == 0,
        F.concat("event_type", F.lit(".dry")),
    ).when(F.col("event_id") % 4 == 1, F.concat("event_type", F.lit(".wet"))).when(F.col("event_id") % 4 == 2, F.col("event_type"))
    return read(spark, d, "events").groupBy(R.wet_role(role).alias("role")).agg(F.count("*").alias("n"))


def media_extensions(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(
        F.when(F.col("doc_id") % 3 == 0, "audio/wav").when(F.col("doc_id") % 3 == 1, "text/plain").otherwise("other/kind").alias("media")
    )
    return docs.groupBy(R.extension(F.col("media")).alias("ext")).agg(F.count("*").alias("n"))


def cues_srt(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").select(
        F.col("conv_id").alias("track"),
        (F.col("turn") * 2.5).alias("t"),
        F.lit(1.25).alias("dur"),
        F.col("text").alias("label"),
    )
    return X.cue_lines(c, ["track"], "srt")


def cues_lrc(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").select(
        F.col("conv_id").alias("track"),
        (F.col("turn") * 61.375).alias("t"),
        F.lit(0.0).alias("dur"),
        F.col("text").alias("label"),
    )
    return X.cue_lines(c, ["track"], "lrc")


def caption(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return docs.select(
        "doc_id",
        X.caption(
            F.col("n_chars") / 100.0,
            F.lit(44100),
            F.col("doc_id") % 2 + 1,
            -F.col("n_chars") / 10.0,
            F.col("doc_id") % 5 == 0,
            F.when(F.col("doc_id") % 3 == 0, -0.25),
            F.lit(0.0),
            F.lit(60.0),
        ).alias("caption"),
    )


def pattern_expand(spark: SparkSession, d: str) -> DataFrame:
    hits = [
        ("kick", "k.wav", 1, 1.0, None, None),
        ("kick", "k.wav", 9, 0.5, None, [1, 3]),
        ("hat", "h.wav", 3, 0.25, -6.0, None),
        ("hat", "h.wav", 4, 0.0, None, None),
        ("hat", "h.wav", 6, 0.8, None, [2]),
    ]
    h = spark.createDataFrame(hits, "track string, source string, step int, velocity double, gain_db double, bars array<int>")
    return X.expand_pattern(h, bars=4, grid=16, swing=0.1).select(
        "track",
        "bar",
        "step",
        F.round("beat", 6).alias("beat"),
        F.round("gain_db", 4).alias("gain_db"),
        "at",
    )


def midi_events_top(spark: SparkSession, d: str) -> DataFrame:
    notes = read(spark, d, "events").select(
        F.col("user_id").alias("stream"),
        (F.col("event_id") % 128).cast("int").alias("pitch"),
        (F.col("event_id") / 10.0).alias("start"),
        (F.col("event_id") / 10.0 + 0.5).alias("end"),
        F.lit(64).alias("velocity"),
    )
    return X.midi_events(notes, ["stream"]).select("stream", "place", "pitch", "start")


def frames_text(spark: SparkSession, d: str) -> DataFrame:
    """Ids come from what a frame is: as many as there are different frames."""
    f = R.text_frames(read(spark, d, "documents"), F.col("text"), role=F.col("lang"), pos=F.col("doc_id"))
    return f.groupBy("role").agg(
        F.count("*").alias("n"),
        F.count_distinct("id").alias("ids"),
        F.count_if(F.size(R.problems()) > 0).alias("bad"),
    )


def _typed(spark: SparkSession, d: str) -> DataFrame:
    """A frame of each kind for each label, from the typed constructors."""
    rows = read(spark, d, "labels").join(_blobs(spark, d), "doc_id").select(
        "*",
        F.concat(F.lit("blake3:"), "hash").alias("h"),
        F.concat(F.lit("f"), "doc_id").alias("name"),
    )
    scores = F.struct(F.col("quality"), F.col("toxic"))
    rollup = F.struct(F.struct(F.when(F.col("toxic") == 1, "cut").otherwise("keep").alias("decision")).alias("rollup"))
    short, points = F.array(F.lit(0.5), F.lit(-0.25)), F.array(F.struct(F.lit(0.5).alias("t"), F.col("lang").alias("label")))
    made = [
        R.audio_frames(rows, F.col("h"), F.lit(44100), F.lit(2), F.lit(1.5), of=F.col("name")),
        R.image_frames(rows, F.col("h"), of=F.col("name")),
        R.feature_frames(rows, scores, of=F.col("name")),
        R.marker_frames(rows, points, of=F.col("name")),
        R.verdict_frames(rows, rollup, F.col("name"), F.array("name", "h"), F.lit("v1")),
        R.vector_frames(
            rows,
            F.lit("m"),
            F.lit(2),
            F.when(F.col("toxic") == 0, short),
            F.when(F.col("toxic") == 1, F.col("h")),
            of=F.col("name"),
        ),
    ]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def frames_typed(spark: SparkSession, d: str) -> DataFrame:
    f = R.validate(_typed(spark, d))
    mark = F.get_json_object("meta", "$.dim").cast("int")
    return f.groupBy("kind", "role", "media").agg(
        F.count("*").alias("n"),
        F.count_if(F.size("problems") > 0).alias("bad"),
        F.count_if(F.col("id").rlike(R.S.HASH_PATTERN)).alias("stamped"),
        F.max(mark).alias("dim"),
    )


def select_stage(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d).withColumn("seq", F.lit(None).cast("bigint"))
    out = R.select_stage(t, role="user")
    return out.select(
        "pos",
        "kind",
        "role",
        F.when(F.col("kind") == "marker", F.get_json_object("data", "$[0].label")).otherwise(F.col("id")).alias("names"),
    )


def check_all(spark: SparkSession, d: str) -> DataFrame:
    """A stage that lost the assistant's turns, and put every fifth of the others before the start."""
    t = _turns(spark, d)
    after = t.where("role is distinct from 'assistant'").withColumn(
        "pos",
        F.when(F.col("pos") % 5 == 0, -F.col("pos")).otherwise(F.col("pos")),
    )
    return R.check_all(t, after).groupBy("check").agg(F.count("*").alias("n"))


def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return R.duplicate_ids(
        R.frame(docs, id=F.substring("text", 1, 12), kind=F.lit("text"), role=F.col("lang"), data=F.col("text"))
    )


def blob_paths(spark: SparkSession, d: str) -> DataFrame:
    media = F.when(F.col("doc_id") % 2 == 0, "text/plain").otherwise("other/kind")
    return _blobs(spark, d).select("doc_id", R.blob_path(F.concat(F.lit("blake3:"), "hash"), media).alias("path"))


def gc_dry_run(spark: SparkSession, d: str) -> DataFrame:
    blobs = _blobs(spark, d).groupBy("hash").agg((F.min("doc_id") * 10).cast("double").alias("age_seconds"))
    refs = _blobs(spark, d).join(read(spark, d, "labels"), "doc_id", "left_semi")
    return R.remove_garbage(
        R.collect_garbage(blobs, refs, 0.5).withColumn("path", F.col("hash")),
        "file:///nowhere",
        dry_run=True,
    )


def frames_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Events as lines of JSON, read as frames."""
    e = read(spark, d, "events")
    line = F.to_json(
        F.struct(
            F.lit(1).alias("v"),
            F.lit("feature").alias("kind"),
            F.col("event_id").cast("string").alias("id"),
            F.col("event_type").alias("role"),
            F.struct(F.col("value")).alias("data"),
            F.array(F.lit("a"), F.col("event_type")).alias("lineage"),
        )
    )
    return RD.parse_frames(e.select(F.col("event_id").alias("pos"), line.alias("value"))).select(
        "pos",
        "v",
        "kind",
        "id",
        "role",
        F.size("lineage").alias("parents"),
        F.round(R.scalar(F.col("data"), "$.value"), 6).alias("value"),
    )


def _transcripts(spark: SparkSession, d: str) -> DataFrame:
    """A segment for each turn, with its words; every third turn has no end, and words have no times but the first's."""
    c = read(spark, d, "conversations").where("text is not null")
    parts = F.split("text", " ")
    words = F.transform(
        parts,
        lambda w, i: F.struct(
            F.when(i == 0, F.col("turn") * 2.5 + 0.5).alias("start"),
            F.when(i == 0, F.col("turn") * 2.5 + 0.75).alias("end"),
            w.alias("word"),
        ),
    )
    segment = F.struct(
        (F.col("turn") * 2.5).alias("start"),
        F.when(F.col("turn") % 3 != 0, F.col("turn") * 2.5 + 1.25).alias("end"),
        F.col("text").alias("text"),
        words.alias("words"),
    )
    return c.groupBy("conv_id").agg(F.collect_list(segment).alias("segments")).select(
        F.col("conv_id").alias("of"),
        F.lit(44100).alias("sr"),
        "segments",
    )


def transcript_points(spark: SparkSession, d: str) -> DataFrame:
    p = X.transcript_points(_transcripts(spark, d))
    return p.groupBy("of", "role").agg(
        F.count("*").alias("n"),
        F.sum("sample").alias("samples"),
        F.round(F.sum("dur"), 6).alias("dur"),
        F.sum(F.length("label")).alias("letters"),
    )


def cues_collected(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as streams: of three, one has segments and words, one has words alone, and one has only texts."""
    c = read(spark, d, "conversations")
    kind = F.when(F.col("conv_id") % 3 == 2, "text").otherwise("marker")
    role = F.when(F.col("conv_id") % 3 == 2, "lyrics").when(
        (F.col("conv_id") % 3 == 0) & (F.col("turn") % 2 == 0),
        "segment",
    ).otherwise("word")
    point = F.to_json(F.array(F.struct((F.col("turn") * 2.5).alias("t"), F.lit(1.25).alias("dur"), F.col("text").alias("label"))))
    f = R.frame(
        c,
        pos=F.col("turn"),
        kind=kind,
        role=role,
        data=F.when(kind == "text", F.col("text")).otherwise(point),
        op=F.col("conv_id"),
    )
    return X.collect_cues(f.withColumn("track", F.col("op").cast("bigint")), ["track"])


def vectors_read(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with an odd id lie in blobs, the others in their frames."""
    v = read(spark, d, "embeddings").withColumn("odd", F.col("vec_id") % 2 == 1)
    text = F.to_json(F.transform("embedding", lambda x: x.cast("double")))
    f = R.frame(
        v,
        kind=F.lit("vector"),
        id=F.col("vec_id"),
        data=F.when(~F.col("odd"), text),
        hash=F.when(F.col("odd"), F.concat(F.lit("b"), "vec_id")),
    )
    blobs = V.npy_blobs(v.where("odd").select(F.concat(F.lit("b"), "vec_id").alias("hash"), F.col("embedding").alias("vector")))
    weighted = F.transform("vector", lambda x, i: x.cast("double") * (i + 1))
    total = F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x)
    return V.read_vectors(f, blobs).select(
        F.col("id").cast("bigint").alias("vec_id"),
        F.size("vector").alias("dim"),
        "error",
        F.round(total, 6).alias("y"),
    )


def registry(spark: SparkSession, d: str) -> DataFrame:
    """A registry of nations: those of one region are entered anew, and those of another leave."""
    held = read(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("bigint").alias("dim"), F.col("n_regionkey").alias("kind"))
    new = held.where("kind = 1").withColumn("dim", F.col("dim") + 100)
    gone = [r.name for r in held.where("kind = 2").select("name").collect()]
    return V.remove(V.upsert(held, new), gone).select("name", "dim", "kind")


def report_sections(spark: SparkSession, d: str) -> DataFrame:
    f = R.frame(
        read(spark, d, "documents"),
        pos=F.col("doc_id"),
        kind=F.lit("text"),
        id=F.col("doc_id"),
        of=F.col("lang"),
        data=F.col("text"),
    )
    return RP.report_rows(f).select("section", "of", "line", "text")


_UNITS_SQL = "CASE key " + " ".join(
    f"WHEN '{k}' THEN '{u}'" for k, u in [
        ("loudness.integrated_lufs", "LUFS"),
        ("loudness.true_peak_dbtp", "dBTP"),
        ("qc.dc_offset_dbfs", "dBFS"),
        ("envelope.rise_slope_db_ms", "dB/ms"),
        ("envelope.attack_ms_10_90", "ms"),
        ("width.bass.correlation", "−1..1"),
        ("width.air.side_mid_ratio", "ratio"),
        ("movement.hf_silence_pct", "%"),
        ("clarity.low_mid_masking_db", "dB"),
        ("rhythm.bpm", "BPM"),
        ("qc.lossy.confidence", "0–1"),
        ("timbre.hardness", "0–100"),
        ("qc.lossy.spectral_cutoff_hz", "Hz"),
    ]
) + " ELSE '' END"
_KEYS_SQL = "(VALUES " + ", ".join(f"('{k}')" for k in _KEYS) + ") k(key)"
_PROBLEMS = [
    ("v IS NULL", "missing v"),
    ("v > 1", "v not supported"),
    ("id IS NULL", "missing id"),
    ("hash IS NOT NULL AND data IS NOT NULL", "hash and data"),
    ("hash IS NOT NULL AND media IS NULL", "hash without media"),
    ("data IS NOT NULL AND strlen(data) > 65536", "inline data too large"),
    ("kind = 'audio' AND hash IS NULL AND data IS NULL", "no payload"),
]
_TYPED = [
    ("audio", "NULL", "'audio/wav'", "NULL"),
    ("image", "'spectrogram'", "'image/png'", "NULL"),
    ("feature", "NULL", "NULL", "NULL"),
    ("marker", "'onset'", "NULL", "NULL"),
    ("verdict", "NULL", "NULL", "NULL"),
]
SQL = {
    "frames_text": "SELECT lang AS role, count(*) AS n, count(DISTINCT text) AS ids, count(*) FILTER (WHERE strlen(text) > 65536) AS bad FROM documents GROUP BY lang",
    "frames_typed": "WITH l AS (SELECT l.* FROM labels l JOIN documents USING (doc_id)), c AS (SELECT count(*) AS n FROM l) " + " UNION ALL ".join(
        f"SELECT '{k}' AS kind, {r}::VARCHAR AS role, {m}::VARCHAR AS media, n, 0::BIGINT AS bad, n AS stamped, {dim}::INTEGER AS dim FROM c" for k, r, m, dim in _TYPED
    ) + " UNION ALL SELECT 'vector', NULL, CASE WHEN toxic = 1 THEN 'application/x-npy' END, count(*), 0, count(*), 2 FROM l GROUP BY ALL",
    "select_stage": f"WITH {_TURNS} SELECT pos, 'text' AS kind, role, id AS names FROM t UNION ALL SELECT max(pos) + 1, 'marker', 'selected', arg_max(id, pos) FILTER (WHERE role = 'user') FROM t",
    "check_all": f"WITH {_TURNS}, a AS (SELECT id, of, CASE WHEN pos % 5 = 0 THEN -pos ELSE pos END AS pos FROM t WHERE role IS DISTINCT FROM 'assistant'), x AS (SELECT 'passthrough' AS check, id FROM t WHERE id NOT IN (SELECT id FROM a) UNION ALL SELECT 'lineage', id FROM a WHERE of IS NOT NULL AND of NOT IN (SELECT id FROM a) UNION ALL SELECT 'ordering', a.id FROM a JOIN a b ON a.of = b.id WHERE b.pos >= a.pos) SELECT \"check\", count(*) AS n FROM x GROUP BY 1",
    "duplicate_ids": "SELECT substring(text, 1, 12) AS id FROM documents GROUP BY 1 HAVING count(DISTINCT (lang, text)) > 1",
    "blob_paths": f"WITH {_BLOBS} SELECT doc_id, hash[1:2] || '/' || hash || CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '.bin' END AS path FROM b",
    "gc_dry_run": f"WITH {_BLOBS}, x AS (SELECT hash, min(doc_id) * 10 AS age FROM b GROUP BY hash), r AS (SELECT DISTINCT hash FROM b WHERE doc_id IN (SELECT doc_id FROM labels)) SELECT CASE WHEN hash IN (SELECT hash FROM r) THEN 'kept' WHEN age < 0.5 THEN 'reserved' ELSE 'removed' END AS fate, count(*) AS n FROM x GROUP BY 1",
    "frames_parsed": "SELECT event_id AS pos, 1 AS v, 'feature' AS kind, event_id::VARCHAR AS id, event_type AS role, 2 AS parents, round(value, 6) AS value FROM events",
    "transcript_points": "WITH c AS (SELECT * FROM conversations WHERE text IS NOT NULL), s AS (SELECT conv_id, 'segment' AS role, turn * 2.5::DOUBLE AS t, CASE WHEN turn % 3 <> 0 THEN 1.25::DOUBLE ELSE 0 END AS dur, trim(text, ' ') AS label FROM c), e AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i FROM c), w AS (SELECT conv_id, 'word' AS role, turn * 2.5::DOUBLE + CASE WHEN i = 0 THEN 0.5 ELSE 0 END AS t, CASE WHEN i = 0 THEN 0.25::DOUBLE ELSE 0 END AS dur, w AS label FROM e) SELECT conv_id AS of, role, count(*) AS n, sum(round_even(t * 44100, 0)::BIGINT)::BIGINT AS samples, round(sum(dur), 6) AS dur, sum(length(label))::BIGINT AS letters FROM (FROM s UNION ALL FROM w) GROUP BY ALL",
    "cues_collected": "WITH c AS (SELECT *, trim(text, ' ') AS label FROM conversations), m AS (SELECT conv_id, turn, label, CASE WHEN conv_id % 3 = 0 AND turn % 2 = 0 THEN 1 ELSE 0 END AS seg, max(CASE WHEN conv_id % 3 = 0 AND turn % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS best FROM c WHERE conv_id % 3 <> 2) SELECT conv_id AS track, turn * 2.5::DOUBLE AS t, 1.25::DOUBLE AS dur, label FROM m WHERE seg = best AND label <> '' UNION ALL SELECT conv_id, 0, 0, trim(arg_max(text, turn), ' ') FROM conversations WHERE conv_id % 3 = 2 GROUP BY conv_id HAVING trim(arg_max(text, turn), ' ') <> ''",
    "vectors_read": "SELECT vec_id, 64 AS dim, NULL::VARCHAR AS error, round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * i)), 6) AS y FROM embeddings",
    "registry": "SELECT n_name AS name, n_nationkey + CASE WHEN n_regionkey = 1 THEN 100 ELSE 0 END AS dim, n_regionkey AS kind FROM nation WHERE n_regionkey <> 2",
    "report_sections": "WITH t AS (SELECT lang AS of, doc_id::VARCHAR AS key, CASE WHEN length(replace(text, chr(10), ' ')) > 200 THEN substring(replace(text, chr(10), ' '), 1, 200) || '…' ELSE replace(text, chr(10), ' ') END AS text FROM documents) SELECT '3 texts' AS section, of, row_number() OVER (PARTITION BY of ORDER BY key, text) AS line, text FROM t UNION ALL SELECT '0 frames', NULL, 1, count(*) || ' text' FROM t",
    "scalar_of": "SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS k FROM events",
    "corpus_content_set": "SELECT count(*) FILTER (WHERE lang = 'en') AS n, count(DISTINCT CASE WHEN lang = 'en' THEN sha256(text) END) AS corpus_size FROM documents",
    "select_last": "SELECT user_id AS stream, max(event_id) AS pos, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id",
    "select_all": "SELECT user_id AS stream, event_id AS pos, event_id AS k FROM events WHERE event_type = 'error'",
    "select_strict_violations": "SELECT user_id AS stream, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) > 1",
    "select_seq_fallback": f"WITH {_TURNS} SELECT stream, CASE WHEN stream::BIGINT % 2 = 0 THEN arg_min(id, pos) WHEN bool_and(seq IS NOT NULL) THEN arg_max(id, (seq, pos)) ELSE arg_max(id, pos) END AS id FROM t GROUP BY stream",
    "select_role_fallback": "WITH c AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS h FROM events GROUP BY user_id) SELECT user_id AS stream, CASE WHEN h = 0 THEN n ELSE h END AS n, h AS n_role FROM c",
    "resolve_hash": f"WITH {_BLOBS}, s AS (SELECT hash, min(doc_id) AS path, max(size) AS size FROM b GROUP BY hash) SELECT l.doc_id AS frame, b.hash, s.path, s.size FROM labels l JOIN b USING (doc_id) JOIN s USING (hash)",
    "lineage_closure": f"WITH {_TURNS}, k AS (SELECT *, role = 'assistant' AS side FROM t WHERE role IS NOT NULL) SELECT id AS child, of AS parent FROM k WHERE of IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k b WHERE b.id = k.of AND b.side = k.side)",
    "lineage_order": f"WITH {_TURNS}, k AS (SELECT id, of, CASE WHEN pos % 5 = 0 THEN -pos ELSE pos END AS pos FROM t) SELECT a.id AS child, a.of AS parent FROM k a JOIN k b ON a.of = b.id WHERE b.pos >= a.pos",
    "lineage_ancestors": f"WITH RECURSIVE {_TURNS}, r AS (SELECT id AS child, of AS anc FROM t WHERE of IS NOT NULL UNION SELECT r.child, t.of FROM r JOIN t ON r.anc = t.id WHERE t.of IS NOT NULL) SELECT child, count(*) AS n FROM r GROUP BY child",
    "passthrough_check": "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "id_collisions": "SELECT substring(text, 1, 12) AS id, count(DISTINCT (lang, text)) AS shapes FROM documents GROUP BY 1 HAVING count(DISTINCT (lang, text)) > 1",
    "frame_validate": "WITH f AS (SELECT CASE WHEN doc_id % 11 <> 0 THEN CASE WHEN doc_id % 13 = 0 THEN 2 ELSE 1 END END AS v, CASE WHEN doc_id % 3 = 0 THEN 'audio' ELSE 'text' END AS kind, CASE WHEN doc_id % 17 <> 0 THEN doc_id::VARCHAR END AS id, CASE WHEN doc_id % 2 = 0 THEN 'h' END AS hash, CASE WHEN doc_id % 5 <> 0 THEN 'm' END AS media, CASE WHEN doc_id % 4 = 0 THEN text END AS data FROM documents) SELECT concat_ws(', ', " + ", ".join(
        f"CASE WHEN {c} THEN '{n}' END" for c, n in _PROBLEMS
    ) + ") AS problems, count(*) AS n FROM f GROUP BY 1",
    "cas_dedup": f"WITH {_BLOBS} SELECT hash, count(*) AS refs, min(size) AS size FROM b GROUP BY hash HAVING count(*) > 1",
    "cas_put": f"WITH {_BLOBS} SELECT DISTINCT hash, size FROM b WHERE doc_id % 2 = 1 AND hash NOT IN (SELECT hash FROM b WHERE doc_id % 2 = 0)",
    "gc_summary": f"WITH {_BLOBS}, x AS (SELECT hash, min(doc_id) * 10 AS age FROM b GROUP BY hash), r AS (SELECT DISTINCT hash FROM b WHERE doc_id IN (SELECT doc_id FROM labels)) SELECT CASE WHEN hash IN (SELECT hash FROM r) THEN 'kept' WHEN age < 3600 THEN 'reserved' ELSE 'removed' END AS fate, count(*) AS n FROM x GROUP BY 1",
    "memo_split": f"WITH {_BLOBS} SELECT doc_id, CASE WHEN hash IN (SELECT hash FROM b WHERE doc_id IN (SELECT doc_id FROM labels)) THEN 'hit' ELSE 'miss' END AS fate FROM b",
    "kind_inventory": "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1",
    "text_snippets": "SELECT doc_id, CASE WHEN length(replace(text, chr(10), ' ')) > 200 THEN substring(replace(text, chr(10), ' '), 1, 200) || '…' ELSE replace(text, chr(10), ' ') END AS snippet FROM documents",
    "union_ordered": "SELECT doc_id AS pos, 'document' AS kind FROM documents UNION ALL SELECT doc_id + 1 + (SELECT max(doc_id) FROM documents), 'label' FROM labels",
    "keys_intersect": "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels",
    "refs_except": "SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels",
    "feature_units": f"SELECT key, {_UNITS_SQL} AS unit FROM {_KEYS_SQL}",
    "short_keys": f"SELECT key, CASE WHEN key LIKE 'spectrum.%' THEN split_part(key, '.', 3) WHEN key = 'width.bass.correlation' THEN 'bass.corr' WHEN key = 'width.air.side_mid_ratio' THEN 'air.smr' ELSE split_part(key, '.', -1) END AS short FROM {_KEYS_SQL}",
    "candidate_labels": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'n' || doc_id WHEN doc_id % 3 = 1 THEN source || '.wav' WHEN doc_id % 2 = 0 THEN substring(sha256(text), 1, 8) ELSE 'cand-' || doc_id END AS label FROM documents",
    "wet_roles": "SELECT CASE WHEN event_id % 4 = 3 THEN 'edit' ELSE event_type END || '.wet' AS role, count(*) AS n FROM events GROUP BY 1",
    "media_extensions": "SELECT CASE doc_id % 3 WHEN 0 THEN 'wav' WHEN 1 THEN 'txt' ELSE 'bin' END AS ext, count(*) AS n FROM documents GROUP BY 1",
    "cues_srt": "WITH c AS (SELECT conv_id AS track, (turn * 2500)::BIGINT AS ms, text AS label, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE trim(text) <> '') SELECT track, n, n || chr(10) || " + " || ' --> ' || ".join(
        f"printf('%02d:%02d:%02d,%03d', ({t}) // 3600000, ({t}) // 60000 % 60, ({t}) // 1000 % 60, ({t}) % 1000)" for t in ("ms", "ms + 1250")
    ) + " || chr(10) || label AS line FROM c",
    "cues_lrc": "WITH c AS (SELECT conv_id AS track, (turn * 61375 / 10)::DOUBLE AS x, text AS label, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE trim(text) <> ''), d AS (SELECT *, round(x)::BIGINT AS cs FROM c) SELECT track, n, printf('[%02d:%02d.%02d]', cs // 6000, cs // 100 % 60, cs % 100) || label AS line FROM d",
    "pattern_expand": "WITH h(track, step, velocity, gain_db, bars) AS (VALUES ('kick', 1, 1.0::DOUBLE, NULL::DOUBLE, NULL::INTEGER[]), ('kick', 9, 0.5, NULL, [1, 3]), ('hat', 3, 0.25, -6.0, NULL), ('hat', 6, 0.8, NULL, [2])), x AS (SELECT *, (bar - 1) * 4 + (step - 1) * 0.25::DOUBLE + CASE WHEN step % 2 = 0 THEN 0.1 * 0.25 ELSE 0 END AS beat FROM h, range(1, 5) r(bar) WHERE bars IS NULL OR list_contains(bars, bar)) SELECT track, bar::INTEGER AS bar, step, round(beat, 6) AS beat, round(coalesce(gain_db, greatest(-40, least(0, 20 * log10(velocity)))), 4) AS gain_db, printf('%d.%d.%03d', (floor(beat / 4) + 1)::BIGINT, (floor(beat - 4 * floor(beat / 4)) + 1)::BIGINT, round((beat - floor(beat)) * 1000)::BIGINT) AS at FROM x",
    "midi_events_top": "SELECT stream, place, pitch, start FROM (SELECT user_id AS stream, (event_id % 128)::INTEGER AS pitch, event_id / 10.0::DOUBLE AS start, row_number() OVER (PARTITION BY user_id ORDER BY event_id / 10.0::DOUBLE, event_id % 128) AS place FROM events) WHERE place <= 512",
    "caption": "SELECT doc_id, printf('%.2f', n_chars / 100.0) || ' s, 44100 Hz, ' || CASE WHEN doc_id % 2 = 0 THEN 'mono' ELSE 'stereo' END || '; ' || printf('%.1f', -n_chars / 10.0) || ' LUFS' || CASE WHEN doc_id % 5 = 0 AND doc_id % 3 = 0 THEN '; QC: clipping, phase' WHEN doc_id % 5 = 0 THEN '; QC: clipping' WHEN doc_id % 3 = 0 THEN '; QC: phase' ELSE '; QC: clean' END AS caption FROM documents",
}
QUERIES = {name: globals()[name] for name in SQL}
