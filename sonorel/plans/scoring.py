"""Profiles, scores, verdicts and calibration over the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorel.operators import calibration as C
from sonorel.operators import frames as FR
from sonorel.operators import profile as P
from sonorel.operators import stages
from sonorel.plans import tables as T
from sonorel.plans.tables import read
from sonorel.storage import broadcast_if_small, materialize


def _profile(spark: SparkSession, d: str) -> DataFrame:
    return P.build_profile(T.line_features(spark, d))


def _axes(spark: SparkSession, d: str) -> DataFrame:
    """The line items are read once; the features that both the profile and the scores need are written."""
    f = materialize(T.line_features(spark, d), "features")
    return P.score_axes(P.last_features(f, ["role", "id"]), _small(P.build_profile(f)), ["role", "key"])


def _small(profile: DataFrame) -> DataFrame:
    return broadcast_if_small(materialize(profile, "profile"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return P.judge(P.score_candidates(_axes(spark, d), ["role", "id"]))


def features_long(spark: SparkSession, d: str) -> DataFrame:
    return T.line_features(spark, d)


def profile_build(spark: SparkSession, d: str) -> DataFrame:
    return _profile(spark, d)


def profile_domain(spark: SparkSession, d: str) -> DataFrame:
    rows = [
        read(spark, d, t).select(
            F.lit(t).alias("role"),
            F.lit("acctbal").alias("key"),
            F.col(c).alias("value"),
        ) for t, c in (("customer", "c_acctbal"), ("supplier", "s_acctbal"))
    ]
    return P.build_profile(rows[0].union(rows[1]))


def robust_z(spark: SparkSession, d: str) -> DataFrame:
    return _axes(spark, d).select("role", "id", "key", "value", "z")


def axis_bands(spark: SparkSession, d: str) -> DataFrame:
    return _axes(spark, d).groupBy("role", "key", "band").agg(F.count("*").alias("n"))


def axis_words(spark: SparkSession, d: str) -> DataFrame:
    return _axes(spark, d).groupBy("key", P.axis_word(F.col("z")).alias("word")).agg(F.count("*").alias("n"))


def candidate_score(spark: SparkSession, d: str) -> DataFrame:
    return P.score_candidates(_axes(spark, d), ["role", "id"]).drop("worst")


def worst_axis(spark: SparkSession, d: str) -> DataFrame:
    return P.score_candidates(_axes(spark, d), ["role", "id"]).select("role", "id", "worst")


def rank_candidates(spark: SparkSession, d: str) -> DataFrame:
    scores = P.score_candidates(_axes(spark, d), ["role", "id"]).withColumn("label", F.concat_ws(":", "role", "id"))
    return P.rank(scores).select("label", "distance", "rank")


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).select(
        "role",
        "id",
        "distance",
        "max_abs",
        "n_axes",
        "min_n",
        "worst",
        "confidence",
        "reason",
        "decision",
        "score",
    )


def verdict_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).groupBy("role", "decision", "confidence").agg(
        F.count("*").alias("n"),
        F.round(F.avg("distance"), 6).alias("mean_distance"),
    )


def verdict_thin_corpus(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part").select(
        F.concat_ws("/", "p_brand", "p_size").alias("role"),
        F.col("p_partkey").alias("id"),
        F.lit(0).alias("pos"),
        "p_retailprice",
    )
    f = P.to_long(part, ["role", "id", "pos"], ["p_retailprice"])
    axes = P.score_axes(P.last_features(f, ["role", "id"]), _small(P.build_profile(f)), ["role", "key"])
    return P.judge(P.score_candidates(axes, ["role", "id"])).select(
        "role",
        "id",
        "max_abs",
        "min_n",
        "confidence",
        "reason",
        "decision",
    )


def axes_tolerance(spark: SparkSession, d: str) -> DataFrame:
    brief = spark.createDataFrame([("l_quantity", 5.0, 40.0), ("l_discount", 0.0, 0.05)], "key string, lo double, hi double")
    return P.in_tolerance(_axes(spark, d), brief).select("role", "id", "key", "value", "in_tolerance")


def verdict_axes(spark: SparkSession, d: str) -> DataFrame:
    return _axes(spark, d).select(
        "role",
        "id",
        "key",
        F.round("value", 6).alias("measured"),
        F.col("median").alias("ref_median"),
        F.col("mad").alias("ref_mad"),
        F.col("n").alias("ref_n"),
        (F.round(F.col("z") + 1e-9, 4) + 0.0).alias("z"),
        F.col("band").alias("verdict"),
    )


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    entries = labels.select(
        F.col("doc_id").alias("id"),
        F.when(F.col("toxic") == 1, "listen").when(F.col("quality") == 1, "keep").otherwise("cut").alias("human_verdict"),
        F.lit("v1").alias("feature_schema"),
    )
    # A role that the profile doesn't know.
    role = F.when(F.col("source") == "src0", "unknown").otherwise(F.col("lang"))
    entries = docs.select(F.col("doc_id").alias("id"), role.alias("role")).join(entries, "id")
    features = docs.select(
        F.col("doc_id").alias("id"),
        F.lit("n_chars").alias("key"),
        F.col("n_chars").cast("double").alias("value"),
    )
    profile = P.build_profile(
        docs.select(F.col("lang").alias("role"), F.lit("n_chars").alias("key"), F.col("n_chars").cast("double").alias("value"))
    )
    return C.score_entries(entries, features, _small(profile), "v2")


def backtest_scored(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return C.confusion(_scored(spark, d))


def per_class_metrics(spark: SparkSession, d: str) -> DataFrame:
    return C.class_metrics(_scored(spark, d))


def gate_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return C.accuracies(_scored(spark, d))


def axis_contribution(spark: SparkSession, d: str) -> DataFrame:
    return C.axis_contribution(_scored(spark, d))


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return C.threshold_sweep(_scored(spark, d))


def skipped_entries(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).groupBy("role", "skipped", "stale").agg(F.count("*").alias("n"))


def verdict_frames(spark: SparkSession, d: str) -> DataFrame:
    """A frame for each judged order, that names its lines' features and the profile."""
    axes = materialize(_axes(spark, d), "axes")
    judged = P.judge(P.score_candidates(axes, ["role", "id"]))
    name = F.concat_ws(":", "role", "id")
    features = F.transform("axes", lambda a: F.concat_ws(":", name, a["key"]))
    f = stages.verdict_stage(axes, judged, ["role", "id"], name, features, "profile:lines", "v1")
    decision, dominant = F.get_json_object("data", "$.rollup.decision"), F.get_json_object("data", "$.rollup.dominant")
    return f.groupBy("kind", decision.alias("decision"), dominant.alias("dominant")).agg(
        F.count("*").alias("n"),
        F.sum(F.size("lineage")).alias("parents"),
        F.count_if(F.size(FR.problems()) > 0).alias("problems"),
    )


def backtest_report(spark: SparkSession, d: str) -> DataFrame:
    return C.report(_scored(spark, d))


def profile_overlay(spark: SparkSession, d: str) -> DataFrame:
    """How far each candidate lies from its profile's median and percentiles."""
    a = _axes(spark, d)
    t = F.when(F.col("domain") == "log10", F.log10(F.when(F.col("value") > 0, F.col("value")))).otherwise(F.col("value"))
    return a.select(
        "role",
        "id",
        "key",
        (F.round(t - F.col("median"), 2) + 0.0).alias("delta"),
        t.between(F.col("p10"), F.col("p90")).alias("inside"),
    )


_SCORED_SQL = f"""WITH src AS (SELECT lang AS role, 'n_chars' AS key, n_chars::DOUBLE AS value FROM documents), {T.profile_sql("src")},
e AS (SELECT d.doc_id AS id, CASE WHEN d.source = 'src0' THEN 'unknown' ELSE d.lang END AS role, CASE WHEN toxic = 1 THEN 'listen' WHEN quality = 1 THEN 'keep' ELSE 'cut' END AS human, d.n_chars::DOUBLE AS value FROM documents d JOIN labels l USING (doc_id)),
axes AS (SELECT e.id, p.role, p.key, p.n, {T.Z_SQL} AS z FROM e JOIN p USING (role)),
{T.SCORES_SQL}, {T.JUDGED_SQL},
scored AS (SELECT e.id, e.role, human, CASE WHEN coalesce(decision, 'listen') = 'alter' THEN 'listen' ELSE coalesce(decision, 'listen') END AS gate, coalesce(decision, 'listen') AS decision, worst, max_abs, coalesce(min_n, 0) AS min_n, coalesce(n_axes, 0) AS n_axes, CASE WHEN NOT EXISTS (SELECT 1 FROM p WHERE p.role = e.role) THEN 'no_profile' END AS skipped, true AS stale FROM e LEFT JOIN j ON e.id = j.id),
ok AS (SELECT * FROM scored WHERE skipped IS NULL),
classes(class) AS (VALUES ('keep'), ('listen'), ('cut')) """
_METRICS_SQL = "m AS (SELECT class, (SELECT count(*) FROM ok WHERE human = class AND gate = class) AS tp, (SELECT count(*) FROM ok WHERE gate = class) AS said, (SELECT count(*) FROM ok WHERE human = class) AS support FROM classes), m2 AS (SELECT *, tp / nullif(said, 0) AS p, tp / nullif(support, 0) AS r FROM m)"
_SWEEP_SQL = ", g(lever, value, z_in, z_far, verdict) AS (VALUES ('z_in', 1.5::DOUBLE, 1.5::DOUBLE, 3.5::DOUBLE, 'keep'), ('z_in', 2.0, 2.0, 3.5, 'keep'), ('z_in', 2.5, 2.5, 3.5, 'keep'), ('z_far', 3.0, 2.0, 3.0, 'cut'), ('z_far', 3.5, 2.0, 3.5, 'cut'), ('z_far', 4.0, 2.0, 4.0, 'cut')), x AS (SELECT *, CASE WHEN n_axes = 0 OR min_n < 12 THEN CASE WHEN max_abs >= z_in AND max_abs < z_far THEN 'alter' ELSE 'listen' END WHEN max_abs < z_in THEN 'keep' WHEN max_abs < z_far THEN 'alter' ELSE 'cut' END AS again FROM ok, g)"

SQL = {
    "features_long": f"WITH {T.FEATURES_SQL} SELECT * FROM f",
    "profile_build": f"WITH {T.FEATURES_SQL}, {T.profile_sql('f')} SELECT * FROM p",
    "profile_domain": f"WITH f AS (SELECT 'customer' AS role, 'acctbal' AS key, c_acctbal AS value FROM customer UNION ALL SELECT 'supplier', 'acctbal', s_acctbal FROM supplier), {T.profile_sql('f')} SELECT * FROM p",
    "robust_z": T.CHAIN_SQL + "SELECT role, id, key, value, z FROM axes",
    "axis_bands": T.CHAIN_SQL + f"SELECT role, key, {T.BAND_SQL} AS band, count(*) AS n FROM axes GROUP BY ALL",
    "axis_words": T.CHAIN_SQL + "SELECT key, CASE WHEN abs(z) < 2 THEN 'PASS' WHEN abs(z) < 3.5 THEN 'ALTER' ELSE 'REJECT' END AS word, count(*) AS n FROM axes GROUP BY ALL",
    "candidate_score": T.CHAIN_SQL + "SELECT role, id, distance, max_abs, n_axes, min_n FROM s",
    "worst_axis": T.CHAIN_SQL + "SELECT role, id, worst FROM s",
    "rank_candidates": T.CHAIN_SQL + "SELECT role || ':' || id AS label, distance, row_number() OVER (ORDER BY distance NULLS LAST, role || ':' || id) AS rank FROM s",
    "verdicts": T.CHAIN_SQL + "SELECT role, id, distance, max_abs, n_axes, min_n, worst, confidence, reason, decision, score FROM j",
    "verdict_rollup": T.CHAIN_SQL + "SELECT role, decision, confidence, count(*) AS n, round(avg(distance), 6) AS mean_distance FROM j GROUP BY ALL",
    "verdict_thin_corpus": f"WITH f AS (SELECT p_brand || '/' || p_size AS role, p_partkey AS id, 0 AS pos, 'p_retailprice' AS key, p_retailprice AS value FROM part), {T.profile_sql('f')}, {T.AXES_SQL}, {T.SCORES_SQL}, {T.JUDGED_SQL} SELECT role, id, max_abs, min_n, confidence, reason, decision FROM j",
    "axes_tolerance": T.CHAIN_SQL + "SELECT role, id, key, value, CASE key WHEN 'l_quantity' THEN value BETWEEN 5 AND 40 WHEN 'l_discount' THEN value BETWEEN 0 AND 0.05 END AS in_tolerance FROM axes",
    "verdict_axes": T.CHAIN_SQL + f"SELECT role, id, key, round(value, 6) AS measured, median AS ref_median, mad AS ref_mad, n AS ref_n, round(z + 1e-9, 4) + 0.0 AS z, {T.BAND_SQL} AS verdict FROM axes",
    "backtest_scored": _SCORED_SQL + "SELECT * FROM scored",
    "confusion_matrix": _SCORED_SQL + "SELECT a.class AS human, b.class AS gate, (SELECT count(*) FROM ok WHERE human = a.class AND gate = b.class) AS n FROM classes a, classes b",
    "per_class_metrics": _SCORED_SQL + f", {_METRICS_SQL} SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, CASE WHEN p = 0 OR r = 0 THEN 0.0::DOUBLE ELSE round(2 * p * r / (p + r), 6) END AS f1, support::BIGINT AS support FROM m2",
    "gate_accuracy": _SCORED_SQL + "SELECT round(count(*) FILTER (WHERE gate = 'keep' AND human = 'keep') / nullif(count(*) FILTER (WHERE gate = 'keep'), 0), 6) AS auto_keep, round(count(*) FILTER (WHERE gate = 'cut' AND human = 'cut') / nullif(count(*) FILTER (WHERE gate = 'cut'), 0), 6) AS auto_cut, round(count(*) FILTER (WHERE gate = human) / nullif(count(*), 0), 6) AS overall, count(*) AS n, coalesce(count(*) FILTER (WHERE gate = 'keep' AND human = 'keep') / nullif(count(*) FILTER (WHERE gate = 'keep'), 0) >= 0.85, false) AS meets_target FROM ok",
    "axis_contribution": _SCORED_SQL + "SELECT coalesce(worst, '(none)') AS axis, count(*) AS n, " + ", ".join(
        f"count(*) FILTER (WHERE {w} = '{c}') AS {w}_{c}" for w in ("human", "gate") for c in C.CLASSES
    ) + ", round(count(*) FILTER (WHERE human = gate) / count(*), 6) AS agree FROM ok GROUP BY 1",
    "threshold_sweep": _SCORED_SQL + _SWEEP_SQL + " SELECT lever, value, count(*) FILTER (WHERE again = verdict) AS n, round(count(*) FILTER (WHERE again = verdict AND human = verdict) / nullif(count(*) FILTER (WHERE again = verdict), 0), 6) AS accuracy FROM x GROUP BY lever, value",
    "verdict_frames": T.CHAIN_SQL
    + "SELECT 'verdict' AS kind, decision, worst AS dominant, count(*) AS n, sum((SELECT count(*) FROM axes a WHERE a.role = j.role AND a.id = j.id) + 1)::BIGINT AS parents, 0::BIGINT AS problems FROM j GROUP BY decision, worst",
    "backtest_report": _SCORED_SQL
    + f", {_METRICS_SQL}"
    + _SWEEP_SQL
    + """, cls AS (SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, CASE WHEN p = 0 OR r = 0 THEN 0.0::DOUBLE ELSE round(2 * p * r / (p + r), 6) END AS f1, support FROM m2),
keeps AS (SELECT count(*) FILTER (WHERE gate = 'keep' AND human = 'keep') / nullif(count(*) FILTER (WHERE gate = 'keep'), 0) AS k, count(*) FILTER (WHERE gate = 'cut' AND human = 'cut') / nullif(count(*) FILTER (WHERE gate = 'cut'), 0) AS c, count(*) FILTER (WHERE gate = human) / nullif(count(*), 0) AS o FROM ok),
sw AS (SELECT lever || '@' || printf('%.1f', value) AS lever, count(*) FILTER (WHERE again = verdict) AS n, round(count(*) FILTER (WHERE again = verdict AND human = verdict) / nullif(count(*) FILTER (WHERE again = verdict), 0), 6) AS accuracy FROM x GROUP BY lever, value),
ax AS (SELECT coalesce(worst, '(none)') AS axis, count(*) AS n, round(count(*) FILTER (WHERE human = gate) / count(*), 6) AS agree FROM ok GROUP BY 1)
SELECT 'entries' AS section, 'scored' AS item, count(*) FILTER (WHERE skipped IS NULL)::DOUBLE AS value FROM scored
UNION ALL SELECT 'entries', 'skipped', count(*) FILTER (WHERE skipped IS NOT NULL) FROM scored UNION ALL SELECT 'entries', 'stale', count(*) FILTER (WHERE stale) FROM scored
UNION ALL SELECT 'confusion', a.class || '/' || b.class, (SELECT count(*) FROM ok WHERE human = a.class AND gate = b.class) FROM classes a, classes b
UNION ALL SELECT 'classes', class || '.precision', precision FROM cls UNION ALL SELECT 'classes', class || '.recall', recall FROM cls UNION ALL SELECT 'classes', class || '.f1', f1 FROM cls UNION ALL SELECT 'classes', class || '.support', support FROM cls
UNION ALL SELECT 'headline', 'auto_keep', round(k, 6) FROM keeps UNION ALL SELECT 'headline', 'auto_cut', round(c, 6) FROM keeps UNION ALL SELECT 'headline', 'overall', round(o, 6) FROM keeps UNION ALL SELECT 'headline', 'meets_target', CASE WHEN k >= 0.85 THEN 1 ELSE 0 END FROM keeps
UNION ALL SELECT 'levers', lever || '.n', n FROM sw UNION ALL SELECT 'levers', lever || '.accuracy', accuracy FROM sw
UNION ALL SELECT 'axes', axis || '.n', n FROM ax UNION ALL SELECT 'axes', axis || '.agree', agree FROM ax""",
    "skipped_entries": _SCORED_SQL + "SELECT role, skipped, stale, count(*) AS n FROM scored GROUP BY ALL",
    "profile_overlay": T.CHAIN_SQL + ", o AS (SELECT a.role, a.id, a.key, CASE WHEN domain = 'log10' THEN log10(nullif(greatest(value, 0), 0)) ELSE value END AS t, p.median, p.p10, p.p90 FROM last a JOIN p USING (role, key)) SELECT role, id, key, round(t - median, 2) + 0.0 AS delta, t BETWEEN p10 AND p90 AS inside FROM o",
}
QUERIES = {name: globals()[name] for name in SQL}
