"""The standard tables as features, frames and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonorel.operators import profile as P

LINE_KEYS = ["l_quantity", "l_extendedprice", "l_discount"]


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def line_features(spark: SparkSession, d: str) -> DataFrame:
    """role, order, pos, key, value of line items."""
    rows = read(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("role"),
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("pos"),
        *LINE_KEYS,
    )
    return P.to_long(rows, ["role", "id", "pos"], LINE_KEYS)


#: DuckDB views that the queries' SQL begins with.
FEATURES_SQL = "f AS (" + " UNION ALL ".join(
    f"SELECT l_returnflag AS role, l_orderkey AS id, l_linenumber AS pos, '{k}' AS key, {k}::DOUBLE AS value FROM lineitem" for k in LINE_KEYS
) + ")"


def profile_sql(source: str, by: str = "role, key", name: str = "p") -> str:
    join = " AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in by.split(","))
    ab = ", ".join(f"a.{c.strip()}" for c in by.split(","))
    return f"""{name}_d AS (SELECT {by}, count(*) AS n, CASE WHEN min(value) > 0 THEN 'log10' ELSE 'linear' END AS domain FROM {source} GROUP BY {by}),
{name}_t AS (SELECT {ab}, b.n, b.domain, CASE WHEN b.domain = 'log10' THEN log10(a.value) ELSE a.value END AS t FROM {source} a JOIN {name}_d b ON {join}),
{name}_q AS (SELECT {by}, quantile_cont(t, 0.1) AS q1, quantile_cont(t, 0.5) AS q5, quantile_cont(t, 0.9) AS q9 FROM {name}_t GROUP BY {by}),
{name}_m AS (SELECT {ab}, median(abs(a.t - b.q5)) AS mad FROM {name}_t a JOIN {name}_q b ON {join} GROUP BY {ab}),
{name} AS (SELECT {by}, round(q5, 6) AS median, round(mad, 6) AS mad, round(q1, 6) AS p10, round(q5, 6) AS p50, round(q9, 6) AS p90, n, domain FROM {name}_d JOIN {name}_q USING ({by}) JOIN {name}_m USING ({by}))"""


Z_SQL = "CASE WHEN domain = 'log10' AND value <= 0 THEN NULL ELSE round(greatest(-12, least(12, ((CASE WHEN domain = 'log10' THEN log10(value) ELSE value END) - median) / greatest(mad, 1e-9))), 6) END"
AXES_SQL = f"last AS (SELECT role, id, key, arg_max(value, (pos, value)) AS value FROM f GROUP BY role, id, key), axes AS (SELECT l.role, l.id, l.key, l.value, p.median, p.mad, p.n, {Z_SQL} AS z FROM last l JOIN p USING (role, key))"
BAND_SQL = "CASE WHEN abs(z) < 2 THEN 'in_band' WHEN abs(z) < 3.5 AND z > 0 THEN 'above' WHEN abs(z) < 3.5 THEN 'below' WHEN z > 0 THEN 'far_above' WHEN z < 0 THEN 'far_below' END"
SCORES_SQL = "s AS (SELECT role, id, round(avg(abs(z)) + 1e-9, 4) AS distance, max(abs(z)) AS max_abs, count(z) AS n_axes, coalesce(min(n), 0)::BIGINT AS min_n, arg_min(key, (-abs(z), key)) FILTER (WHERE z IS NOT NULL) AS worst FROM axes GROUP BY role, id)"
CONFIDENCE_SQL = "CASE WHEN n_axes = 0 OR min_n < 12 THEN 'low' WHEN max_abs < 1.5 OR max_abs >= 4 THEN 'high' ELSE 'med' END"
BASE_SQL = "CASE WHEN max_abs < 2 THEN 'keep' WHEN max_abs < 3.5 THEN 'alter' ELSE 'cut' END"
JUDGED_SQL = f"j AS (SELECT *, CASE WHEN confidence = 'low' AND base <> 'alter' THEN 'listen' ELSE base END AS decision, CASE WHEN n_axes = 0 THEN 'no_overlap' WHEN min_n < 12 THEN 'insufficient_corpus' END AS reason, round(100 / (1 + distance))::INTEGER AS score FROM (SELECT *, {CONFIDENCE_SQL} AS confidence, {BASE_SQL} AS base FROM s))"
CHAIN_SQL = f"WITH {FEATURES_SQL}, {profile_sql('f')}, {AXES_SQL}, {SCORES_SQL}, {JUDGED_SQL} "
