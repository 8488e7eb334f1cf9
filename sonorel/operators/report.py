"""Reports over streams of frames, as rows and as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonorel.operators.frames import unit_of
from sonorel.operators.text import IMAGES, POINTS, snippet

INLINE = 65_536 - 1024


def flattened(data: Column) -> Column:
    """array<struct<key, value>> of a feature's JSON: one nested level by dotted keys, {mean, stdev} as m (±s), lists by their first eight."""
    top = F.from_json(data, "map<string,string>")

    def text(v: Column) -> Column:
        mean, dev = F.get_json_object(v, "$.mean"), F.get_json_object(v, "$.stdev")
        items = F.from_json(v, "array<string>")
        return F.when(
            v.startswith("{") & mean.isNotNull(),
            F.concat(mean, F.lit(" (±"), F.coalesce(dev, F.lit("0")), F.lit(")")),
        ).when(v.startswith("["), F.array_join(F.slice(items, 1, 8), ", ")).otherwise(v)

    def entry(e: Column) -> Column:
        inner = F.from_json(e["value"], "map<string,string>")
        plain = ~e["value"].startswith("{") | F.get_json_object(e["value"], "$.mean").isNotNull()
        one = F.array(F.struct(e["key"].alias("key"), text(e["value"]).alias("value")))
        nested = F.transform(
            F.map_entries(inner),
            lambda x: F.struct(F.concat(e["key"], F.lit("."), x["key"]).alias("key"), text(x["value"]).alias("value")),
        )
        return F.when(plain, one).otherwise(nested)

    return F.flatten(F.transform(F.map_entries(top), entry))


def report_rows(frames: DataFrame) -> DataFrame:
    """section, of, line (number), text: the body of a report, in parts that are each bounded."""
    counts = frames.groupBy("kind").agg(F.count("*").alias("n")).select(
        F.lit("0 frames").alias("section"),
        F.lit(None).cast("string").alias("of"),
        F.col("kind").alias("key"),
        F.concat_ws(" ", "n", "kind").alias("text"),
    )
    each = frames.where("kind = 'feature'").select("of", F.explode(flattened(F.col("data"))).alias("e")).select(
        F.lit("1 features").alias("section"),
        "of",
        F.col("e.key").alias("key"),
        F.concat(
            F.col("e.key"),
            F.lit(": "),
            F.col("e.value"),
            F.when(unit_of(F.col("e.key")) != "", F.concat(F.lit(" "), unit_of(F.col("e.key")))).otherwise(""),
        ).alias("text"),
    )
    points = frames.where("kind = 'marker'").select(
        "of",
        F.posexplode(F.from_json("data", "array<struct<t:double,label:string>>")).alias("i", "p"),
    ).where(F.col("i") < POINTS)
    points = points.select(
        F.lit("2 markers").alias("section"),
        "of",
        F.lpad(F.col("i").cast("string"), 6, "0").alias("key"),
        F.concat_ws(" ", F.format_string("%.3f s", "p.t"), "p.label").alias("text"),
    )
    texts = frames.where("kind = 'text'").select(
        F.lit("3 texts").alias("section"),
        "of",
        F.col("id").alias("key"),
        snippet(F.col("data")).alias("text"),
    )
    errors = frames.where("kind = 'error'").select(
        F.lit("5 errors").alias("section"),
        "of",
        F.col("id").alias("key"),
        F.concat_ws(": ", F.get_json_object("data", "$.code"), F.get_json_object("data", "$.message")).alias("text"),
    )
    images = frames.where("kind = 'image'").orderBy("pos").limit(IMAGES).select(
        F.lit("4 images").alias("section"),
        "of",
        F.col("id").alias("key"),
        F.col("hash").alias("text"),
    )
    rows = counts.union(each).union(points).union(texts).union(images).union(errors)
    return rows.withColumn("line", F.row_number().over(Window.partitionBy("section", "of").orderBy("key", "text")))


def markdown(rows: DataFrame) -> str:
    """A report of one stream as text, which is bounded by what a reader takes in: it is put together on the driver."""
    out, section, of = [], None, object()
    for r in rows.orderBy("section", F.col("of").asc_nulls_first(), "line").toLocalIterator():
        if r.section != section:
            out.append(f"\n## {r.section[2:]}\n")
            section, of = r.section, object()
        if r.of != of and r.of is not None:
            out.append(f"\n### {r.of}\n")
            of = r.of
        out.append(f"- {r.text}")
    return "\n".join(out).strip() + "\n"


def placed(text: str) -> str:
    """Where a report belongs."""
    return "inline" if len(text.encode()) <= INLINE else "blob"


def contact_sheet(ranked: DataFrame, axes: DataFrame, columns: int = 4, by: str = "label") -> DataFrame:
    """rank, row, column, label, distance, worst (the two worst axes): a sheet's tiles in order of rank."""
    size = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.abs("z")), "key"))
    two = axes.where("z is not null").withColumn("n", size).where("n <= 2").groupBy(by).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("n", F.concat_ws(" ", "key", F.format_string("%+.1f", "z")).alias("t")))),
                lambda x: x["t"],
            ),
            ", ",
        ).alias("worst_two")
    )
    tile = F.col("rank") - 1
    return ranked.join(two, by, "left").select(
        "rank",
        F.floor(tile / columns).alias("row"),
        F.pmod(tile, F.lit(columns)).alias("column"),
        by,
        "distance",
        "worst_two",
    )
