"""Backtesting the gate against human verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonorel.operators import profile as P
from sonorel.storage import broadcast_if_small, materialize

CLASSES = ("keep", "listen", "cut")
KEEP_TARGET = 0.85
OFFSETS = (-0.5, 0.0, 0.5)


def fold(verdict: Column) -> Column:
    """alter counts as listen."""
    return F.when(verdict == "alter", "listen").otherwise(verdict)


def score_entries(entries: DataFrame, features: DataFrame, profile: DataFrame, current_schema: str | None = None) -> DataFrame:
    """id, role, human, gate (three classes), decision, worst, max_abs, min_n, n_axes, skipped, stale.

    entries: id, role, human_verdict, feature_schema; features: id, key, value;
    profile: role, key, ... A row without verdict or without a profile for its
    role is skipped, with the reason."""
    known = profile.select("role").distinct().withColumn("has_profile", F.lit(True))
    axes = P.score_axes(features.join(entries.select("id", "role"), "id"), profile, ["role", "key"])
    scores = P.judge(P.score_candidates(axes, ["id"]))
    out = entries.join(broadcast_if_small(known), "role", "left").join(scores, "id", "left")
    skipped = F.when(F.col("human_verdict").isNull(), "no_human_verdict").when(F.col("has_profile").isNull(), "no_profile")
    # Nothing in common with the profile: the gate can't tell, and asks to listen.
    gate = F.coalesce(F.col("decision"), F.lit("listen"))
    stale = F.lit(False) if current_schema is None else F.coalesce(F.col("feature_schema") != current_schema, F.lit(False))
    return out.select(
        "id",
        "role",
        fold(F.col("human_verdict")).alias("human"),
        fold(gate).alias("gate"),
        gate.alias("decision"),
        "worst",
        "max_abs",
        F.coalesce("min_n", F.lit(0)).alias("min_n"),
        F.coalesce("n_axes", F.lit(0)).alias("n_axes"),
        skipped.alias("skipped"),
        stale.alias("stale"),
    )


def _grid(df: DataFrame, *names: str) -> DataFrame:
    spark = df.sparkSession
    out = spark.createDataFrame([(c,) for c in CLASSES], f"{names[0]} string")
    for n in names[1:]:
        out = out.join(F.broadcast(spark.createDataFrame([(c,) for c in CLASSES], f"{n} string")))
    return out


def confusion(scored: DataFrame) -> DataFrame:
    """human, gate, n: all nine cells."""
    counts = scored.where("skipped is null").groupBy("human", "gate").agg(F.count("*").alias("n"))
    return _grid(scored, "human", "gate").join(counts, ["human", "gate"], "left").select(
        "human",
        "gate",
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def class_metrics(scored: DataFrame) -> DataFrame:
    """class, precision, recall, f1, support; null where the denominator is zero, f1 zero where either is zero."""
    s = scored.where("skipped is null")
    rows = _grid(scored, "class").join(F.broadcast(confusion(s)), F.lit(True))
    c = rows.groupBy("class").agg(
        F.sum(
            F.when((F.col("human") == F.col("class")) & (F.col("gate") == F.col("class")), F.col("n")).otherwise(0)
        ).alias("tp"),
        F.sum(F.when(F.col("gate") == F.col("class"), F.col("n")).otherwise(0)).alias("said"),
        F.sum(F.when(F.col("human") == F.col("class"), F.col("n")).otherwise(0)).alias("support"),
    )
    c = c.withColumns({"precision": F.try_divide("tp", "said"), "recall": F.try_divide("tp", "support")})
    f1 = F.when(F.col("precision").isNull() | F.col("recall").isNull(), None).when((F.col("precision") == 0) | (F.col("recall") == 0), 0.0).otherwise(
        2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
    )
    return c.select(
        "class",
        F.round("precision", 6).alias("precision"),
        F.round("recall", 6).alias("recall"),
        F.round(f1, 6).alias("f1"),
        "support",
    )


def accuracies(scored: DataFrame) -> DataFrame:
    """auto_keep, auto_cut, overall, meets_target of all rows that weren't skipped."""
    s = scored.where("skipped is null")
    right = F.col("human") == F.col("gate")
    share = lambda c: F.round(
        F.try_divide(F.count_if(right & (F.col("gate") == c)), F.count_if(F.col("gate") == c)),
        6,
    )
    out = s.agg(
        share("keep").alias("auto_keep"),
        share("cut").alias("auto_cut"),
        F.round(F.try_divide(F.count_if(right), F.count("*")), 6).alias("overall"),
        F.count("*").alias("n"),
    )
    return out.withColumn("meets_target", F.coalesce(F.col("auto_keep") >= KEEP_TARGET, F.lit(False)))


def axis_contribution(scored: DataFrame) -> DataFrame:
    """By dominant axis: n, human and gate verdicts, and the share of rows on which they agree."""
    s = scored.where("skipped is null").withColumn("axis", F.coalesce("worst", F.lit("(none)")))
    split = lambda who: [F.count_if(F.col(who) == c).alias(f"{who}_{c}") for c in CLASSES]
    return s.groupBy("axis").agg(
        F.count("*").alias("n"),
        *split("human"),
        *split("gate"),
        F.round(F.count_if(F.col("human") == F.col("gate")) / F.count("*"), 6).alias("agree"),
    )


def threshold_sweep(scored: DataFrame) -> DataFrame:
    """lever, value, n, accuracy: how precise keep is as z_in shifts, and cut as z_far shifts."""
    spark = scored.sparkSession
    levers = [("z_in", P.Z_IN + o, P.Z_IN + o, P.Z_FAR, "keep") for o in OFFSETS] + [
        ("z_far", P.Z_FAR + o, P.Z_IN, P.Z_FAR + o, "cut") for o in OFFSETS
    ]
    grid = spark.createDataFrame(levers, "lever string, value double, z_in double, z_far double, verdict string")
    size = F.coalesce(F.col("max_abs"), F.lit(float("inf")))
    again = P.decision(size, P.confidence(F.col("n_axes"), F.col("min_n"), size), F.col("z_in"), F.col("z_far"))
    hit = again == F.col("verdict")
    s = scored.where("skipped is null").join(F.broadcast(grid))
    return s.groupBy("lever", "value").agg(
        F.count_if(hit).alias("n"),
        F.round(F.try_divide(F.count_if(hit & (F.col("human") == F.col("verdict"))), F.count_if(hit)), 6).alias("accuracy"),
    )


def report(scored: DataFrame) -> DataFrame:
    """section, item, value: a whole calibration report as rows, of which there are few. scored is written first, as each
    section reads it."""
    scored = materialize(scored, "scored")
    cell = F.concat_ws("/", "human", "gate")
    said = scored.agg(
        F.count_if(F.col("skipped").isNull()).alias("scored"),
        F.count_if(F.col("skipped").isNotNull()).alias("skipped"),
        F.count_if("stale").alias("stale"),
    )
    wide = lambda df, name, *keys: df.select(
        name,
        *[F.col(k).cast("double").alias(k) for k in keys],
    ).unpivot([name], list(keys), "key", "value")
    one = lambda df, *keys: df.select(
        F.lit("").alias("none"),
        *[F.col(k).cast("double").alias(k) for k in keys],
    ).unpivot(["none"], list(keys), "item", "value").drop("none")
    dotted = lambda df, name: df.select(F.concat_ws(".", name, "key").alias("item"), "value")
    parts = {
        "entries": one(said, "scored", "skipped", "stale"),
        "confusion": confusion(scored).select(cell.alias("item"), F.col("n").cast("double").alias("value")),
        "classes": dotted(wide(class_metrics(scored), "class", "precision", "recall", "f1", "support"), "class"),
        "headline": one(
            accuracies(scored).withColumn("meets_target", F.col("meets_target").cast("int")),
            "auto_keep",
            "auto_cut",
            "overall",
            "meets_target",
        ),
        "levers": dotted(
            wide(
                threshold_sweep(scored).withColumn("lever", F.concat_ws("@", "lever", F.format_number("value", 1))),
                "lever",
                "n",
                "accuracy",
            ),
            "lever",
        ),
        "axes": dotted(wide(axis_contribution(scored), "axis", "n", "agree"), "axis"),
    }
    out = None
    for name, rows in parts.items():
        part = rows.select(F.lit(name).alias("section"), "item", "value")
        out = part if out is None else out.unionByName(part)
    return out


def report_text(rows: DataFrame) -> str:
    """The report of report() for a reader."""
    held: dict[str, dict[str, float | None]] = {}
    for r in rows.collect():
        held.setdefault(r.section, {})[r.item] = r.value
    shown = lambda v: "-" if v is None else f"{v:g}" if v == int(v) else f"{v:.3f}"
    lines = []
    for section, items in held.items():
        lines += [section, *[f"  {item:<24}{shown(value):>10}" for item, value in sorted(items.items())]]
    return "\n".join(lines) + "\n"
