"""Corpus profiles: robust statistics per role and key, and scores against them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonorel.storage import broadcast_if_small, materialize

#: Fixed values of the scoring rules.
Z_IN, Z_FAR, Z_CLAMP, MAD_FLOOR = 2.0, 3.5, 12.0, 1e-9
LEAST_CORPUS, SURE_IN, SURE_OUT = 12, 1.5, 4.0
QUANTILES = (0.1, 0.5, 0.9)
#: Values of a group that one task reduces whole (8 MB).
MOST_IN_TASK = 1_000_000


def to_long(df: DataFrame, ids: list[str], keys: list[str]) -> DataFrame:
    """Wide measurements as rows (ids..., key, value)."""
    return df.select(*ids, *[F.col(k).cast("double").alias(k) for k in keys]).unpivot(ids, keys, "key", "value")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def build_profile(features: DataFrame, by: list[str] | None = None, most_in_task: int = MOST_IN_TASK) -> DataFrame:
    """by..., key, median, mad, p10, p50, p90, n, domain of the finite values.

    All-positive keys are reduced in log10. Groups are counted first. Where the largest
    has at most `most_in_task` values, each group is reduced whole in one task, after
    one shuffle. Beyond, quantiles are found by bracketing (bracketed_quantiles), so no
    task holds a group's values; both ways give the same numbers. The features are read
    once to count and once to reduce: write costly ones first."""
    by = [*(by if by is not None else ["role"]), "key"]
    rows = features.where(finite(F.col("value"))).select(*by, "value")
    domain = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.when(F.min("value") > 0, "log10").otherwise("linear").alias("domain"),
    )
    domain = materialize(domain, "domains")
    if (domain.agg(F.max("n")).first()[0] or 0) <= most_in_task:
        return whole_groups(rows, by)
    small = broadcast_if_small(domain)
    scaled = rows.join(small, by).select(
        *by,
        F.when(F.col("domain") == "log10", F.log10("value")).otherwise(F.col("value")).alias("t"),
    )
    q = materialize(bracketed_quantiles(scaled, by, "t", list(QUANTILES)), "quantiles")
    apart = scaled.join(broadcast_if_small(q), by).select(*by, F.abs(F.col("t") - F.col("q")[1]).alias("apart"))
    mad = bracketed_quantiles(apart, by, "apart", [0.5]).select(*by, F.col("q")[0].alias("mad"))
    r = lambda c: F.round(c, 6)
    return domain.join(q, by).join(mad, by).select(
        *by,
        r(F.col("q")[1]).alias("median"),
        r(F.col("mad")).alias("mad"),
        r(F.col("q")[0]).alias("p10"),
        r(F.col("q")[1]).alias("p50"),
        r(F.col("q")[2]).alias("p90"),
        "n",
        "domain",
    )


def whole_groups(rows: DataFrame, by: list[str]) -> DataFrame:
    """The profile of groups that each fit a task. rows: by..., value."""

    def reduce(key: tuple, own: pa.Table) -> pa.Table:
        x = own.column("value").to_numpy()
        positive = bool(x.min() > 0)
        t = np.log10(x) if positive else x
        low, mid, high = np.quantile(t, QUANTILES)
        values = [mid, np.median(np.abs(t - mid)), low, mid, high]
        columns = {c: own.column(c).slice(0, 1) for c in by}
        columns |= {c: pa.array([float(v)]) for c, v in zip(("median", "mad", "p10", "p50", "p90"), values)}
        return pa.table(columns | {"n": pa.array([len(x)], pa.int64()), "domain": pa.array(["log10" if positive else "linear"])})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema.fields)
    out = rows.groupBy(*by).applyInArrow(
        reduce,
        f"{kinds}, median double, mad double, p10 double, p50 double, p90 double, n bigint, domain string",
    )
    return out.select(*by, *[F.round(c, 6).alias(c) for c in ("median", "mad", "p10", "p50", "p90")], "n", "domain")


def bracketed_quantiles(df: DataFrame, by: list[str], value: str, qs: list[float], accuracy: int = 1000) -> DataFrame:
    """by..., q: exact linear-interpolated quantiles. A mergeable sketch brackets each quantile; values below the
    bracket are counted, and only those inside are sorted."""
    pad, df = 2.0 / accuracy, df.select(*by, value)
    asked = [x for q in qs for x in (max(0.0, q - pad), min(1.0, q + pad))]
    cuts = df.groupBy(*by).agg(
        F.percentile_approx(value, asked, accuracy).alias("cut"),
        F.count("*").alias("n"),
        F.min(value).alias("lo"),
        F.max(value).alias("hi"),
    )
    joined = df.join(broadcast_if_small(materialize(cuts, "cuts")), by)
    inside = F.array(
        *[F.struct(F.lit(k).alias("k"), F.when(F.lit(q - pad <= 0), F.col("lo")).otherwise(F.col("cut")[2 * k]).alias("a"), F.when(F.lit(q + pad >= 1), F.col("hi")).otherwise(F.col("cut")[2 * k + 1]).alias("b")) for k, q in enumerate(qs)]
    )
    each = joined.select(*by, "n", F.col(value).alias("x"), F.explode(inside).alias("c"))
    low = each.groupBy(*by, "c.k").agg(F.count_if(F.col("x") < F.col("c.a")).alias("below"))
    some = each.where((F.col("x") >= F.col("c.a")) & (F.col("x") <= F.col("c.b"))).select(*by, "n", "x", F.col("c.k").alias("k"))
    place = F.row_number().over(Window.partitionBy(*by, "k").orderBy("x"))
    ranked = some.withColumn("place", place).join(low, [*by, "k"]).withColumn("rank", F.col("below") + F.col("place") - 1)
    q = F.get(F.array(*map(F.lit, qs)), F.col("k"))
    at = q * (F.col("n") - 1)
    picked = ranked.withColumns({"f": F.floor(at), "w": at - F.floor(at)}).groupBy(*by, "k").agg(
        F.max(F.when(F.col("rank") == F.col("f"), F.col("x"))).alias("x0"),
        F.max(F.when(F.col("rank") == F.col("f") + 1, F.col("x"))).alias("x1"),
        F.max("w").alias("w"),
    )
    one = F.when(F.col("w") > 0, F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("w")).otherwise(F.col("x0"))
    return picked.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", one.alias("v")))), lambda s: s["v"]).alias("q")
    )


def robust_z(value: Column, domain: Column, median: Column, mad: Column) -> Column:
    """Null for values that aren't finite, or not positive where the profile is in log10; clamped."""
    t = F.when(domain == "log10", F.when(value > 0, F.log10(value))).otherwise(F.when(finite(value), value))
    z = (t - median) / F.greatest(mad, F.lit(MAD_FLOOR))
    return F.when(t.isNotNull() & median.isNotNull() & mad.isNotNull(), F.greatest(F.lit(-Z_CLAMP), F.least(F.lit(Z_CLAMP), z)))


def axis_band(z: Column) -> Column:
    size = F.abs(z)
    return F.when(size < Z_IN, "in_band").when((size < Z_FAR) & (z > 0), "above").when(size < Z_FAR, "below").when(z > 0, "far_above").when(z < 0, "far_below")


def axis_word(z: Column) -> Column:
    return F.when(F.abs(z) < Z_IN, "PASS").when(F.abs(z) < Z_FAR, "ALTER").otherwise("REJECT")


def last_features(features: DataFrame, by: list[str]) -> DataFrame:
    """The latest value of each key, by pos; of those at one place the largest."""
    return features.groupBy(*by, "key").agg(F.max_by("value", F.struct("pos", "value")).alias("value"))


def score_axes(features: DataFrame, profile: DataFrame, on: list[str]) -> DataFrame:
    """Features that the profile knows, with z (6 decimals) and band. The profile has a row per role and key."""
    joined = features.join(profile, on)
    z = F.round(robust_z(F.col("value"), F.col("domain"), F.col("median"), F.col("mad")), 6)
    return joined.withColumn("z", z).withColumn("band", axis_band(F.col("z")))


def decision(max_abs: Column, confidence: Column, z_in: Column | float = Z_IN, z_far: Column | float = Z_FAR) -> Column:
    """keep, alter or cut; where confidence is low, keep and cut become listen."""
    base = F.when(max_abs < z_in, "keep").when(max_abs < z_far, "alter").otherwise("cut")
    return F.when((confidence == "low") & (base != "alter"), "listen").otherwise(base)


def confidence(n_axes: Column, min_n: Column, max_abs: Column, least: int = LEAST_CORPUS) -> Column:
    return F.when(n_axes == 0, "low").when(min_n < least, "low").when(
        (max_abs < SURE_IN) | (max_abs >= SURE_OUT),
        "high",
    ).otherwise("med")


def reason(n_axes: Column, min_n: Column, least: int = LEAST_CORPUS) -> Column:
    return F.when(n_axes == 0, "no_overlap").when(min_n < least, "insufficient_corpus")


def score_candidates(axes: DataFrame, by: list[str]) -> DataFrame:
    """by..., distance (mean |z|, 4 decimals), max_abs, n_axes, min_n, worst (dominant axis): one row per candidate."""
    size = F.abs(F.col("z"))
    first = F.min(F.when(F.col("z").isNotNull(), F.struct((-size).alias("s"), F.col("key"))))
    return axes.groupBy(*by).agg(
        F.round(F.avg(size) + 1e-9, 4).alias("distance"),
        F.max(size).alias("max_abs"),
        F.count("z").alias("n_axes"),
        F.coalesce(F.min("n"), F.lit(0)).cast("long").alias("min_n"),
        first["key"].alias("worst"),
    )


def judge(scores: DataFrame) -> DataFrame:
    """Adds confidence, reason, decision and score (0..100, null if unscored)."""
    unscored = F.coalesce(F.col("max_abs"), F.lit(float("inf")))
    out = scores.withColumns(
        {"confidence": confidence(F.col("n_axes"), F.col("min_n"), unscored), "reason": reason(F.col("n_axes"), F.col("min_n"))}
    )
    return out.withColumns(
        {"decision": decision(unscored, F.col("confidence")), "score": F.round(100 / (1 + F.col("distance"))).cast("int")}
    )


def rank(scores: DataFrame, label: str = "label") -> DataFrame:
    """Best first; unscored candidates last; ties by label. Numbers ranges of scores apart, so no task gets all rows."""
    return numbered(scores, [F.col("distance").asc_nulls_last(), F.col(label)], "rank")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds 1, 2, ... in an order over all rows: rows are sorted in ranges, ranges are counted, and their totals added up."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(
        df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()),
        "ranged",
    )
    part = F.shiftright("_id", 33)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    local = F.col("_id") - F.shiftleft(F.col("_part"), 33)
    return ranged.withColumn("_part", part).join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + local + 1).drop("_id", "_part", "_base")


def in_tolerance(axes: DataFrame, brief: DataFrame) -> DataFrame:
    """Adds in_tolerance: lo <= value <= hi of the brief, null where it doesn't name the key."""
    return axes.join(F.broadcast(brief.select("key", "lo", "hi")), "key", "left").withColumn(
        "in_tolerance",
        F.when(
            F.col("lo").isNotNull() | F.col("hi").isNotNull(),
            F.col("value").between(F.coalesce("lo", F.lit(float("-inf"))), F.coalesce("hi", F.lit(float("inf")))),
        ),
    ).drop("lo", "hi")


def content_set(frames: DataFrame) -> DataFrame:
    """One row: n (audio frames, repeats included), corpus_size (distinct hashes)."""
    audio = F.col("kind") == "audio"
    return frames.agg(F.count_if(audio).alias("n"), F.count_distinct(F.when(audio, F.col("hash"))).alias("corpus_size"))
