"""Frames, corpora, profiles and briefs from JSON text, and the sinks that write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonorel import schema as S

_TEXT = {"v", "seq", "consumed"}


def parse_frames(lines: DataFrame) -> DataFrame:
    """schema.FRAME from rows (pos, value). Blank lines go; a line that isn't an object, or too long, fails the read."""
    some = lines.where(F.trim("value") != "")
    wrong = F.when(
        ~F.trim("value").startswith("{") | F.try_parse_json("value").isNull() | (F.octet_length("value") > S.MAX_LINE_BYTES),
        F.raise_error(F.concat(F.lit("not a frame: "), F.substring("value", 1, 80))),
    )
    checked = some.where(wrong.isNull())
    fields = [c.split(" ", 1) for c in S.FRAME.split(", ")]

    def field(name: str, kind: str) -> Column:
        if name == "pos":
            return F.col("pos")
        if name == "raw":
            return F.col("value")
        got = F.get_json_object("value", f"$.{name}")
        return (F.from_json(got, kind) if kind.startswith("array") else got.try_cast(kind)).alias(name)

    return checked.select(*[field(n, k).alias(n) for n, k in fields])


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """A file or folder of frames. Whole files are numbered by their lines; the place of a file comes before that of its lines."""
    files = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    order = F.dense_rank().over(Window.orderBy("file"))
    names = files.select("file").distinct().select("file", order.alias("nth"))
    return parse_frames(
        lines.join(F.broadcast(names), "file").select(
            (F.col("nth").cast("bigint") * (1 << 32) + F.col("line")).alias("pos"),
            "value",
        )
    )


def write_frames(frames: DataFrame, path: str) -> None:
    """The lines as they were read, or as JSON where a frame is new, in order; unknown fields stay."""
    known = F.struct(
        *[F.col(c.split()[0]) for c in S.FRAME.split(", ") if c.split()[0] not in ("pos", "raw", "params", "meta", "data")]
    )
    nested = [
        F.when(
            F.col(c).isNotNull(),
            F.concat(
                F.lit(f',"{c}":'),
                F.when(F.try_parse_json(c).isNotNull(), F.col(c)).otherwise(
                    F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
                ),
            ),
        ).otherwise("") for c in ("params", "meta", "data")
    ]
    made = F.concat(F.regexp_replace(F.to_json(known), r"\}$", ""), *nested, F.lit("}"))
    frames.orderBy("pos").select(F.coalesce("raw", made).alias("value")).write.text(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """id, role, human_verdict, features map, feature_schema, note: JSON lines, with blank lines and # comments between, or one JSON array."""
    kind = "id string, role string, human_verdict string, features map<string,double>, sample_path string, feature_schema string, note string"
    whole = spark.read.option("wholetext", "true").text(path)
    array = F.trim("value").startswith("[")
    from_array = whole.where(array).select(
        F.explode(F.from_json("value", f"array<struct<{kind.replace(' string', ':string').replace(' map', ':map')}>>")).alias("r")
    )
    lines = whole.where(~array).select(F.explode(F.split("value", "\r?\n")).alias("line")).where(
        (F.trim("line") != "") & ~F.trim("line").startswith("#")
    )
    return from_array.union(lines.select(F.from_json("line", kind).alias("r"))).select("r.*")


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """role, key and statistics, from a whole profile ({role, stats: {key: ...}}) or a bare object of keys."""
    stat = "struct<median:double,mad:double,p10:double,p50:double,p90:double,n:bigint,domain:string>"
    text = spark.read.option("wholetext", "true").text(path)
    inner = F.coalesce(F.get_json_object("value", "$.stats"), F.get_json_object("value", "$.keys"), F.col("value"))
    rows = text.select(
        F.get_json_object("value", "$.role").alias("role"),
        F.explode(F.from_json(inner, f"map<string,{stat}>")).alias("key", "s"),
    )
    return rows.where("s.median is not null").select("role", "key", "s.*")


def read_brief(spark: SparkSession, path: str) -> DataFrame:
    """key, lo, hi from {key: [lo, hi]} or {key: {min, max}}."""
    text = spark.read.option("wholetext", "true").text(path)
    rows = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "v"))
    pair = F.from_json("v", "array<double>")
    edge = lambda i, name: F.when(F.col("v").startswith("["), F.get(pair, F.lit(i))).otherwise(
        F.get_json_object("v", f"$.{name}").try_cast("double")
    )
    return rows.select("key", edge(0, "min").alias("lo"), edge(1, "max").alias("hi"))


def resolve_prompt(frames: DataFrame, flag: str | None = None, stdin: str | None = None) -> DataFrame:
    """One row, prompt and id: the flag, else raw input, else the first text frame of role prompt, which is then consumed."""
    first = frames.where("kind = 'text' and role = 'prompt'").agg(F.min_by(F.struct("data", "id"), "pos").alias("f"))
    given = flag if flag is not None else stdin
    if given is not None:
        return first.select(F.lit(given).alias("prompt"), F.lit(None).cast("string").alias("id"))
    return first.select(F.col("f.data").alias("prompt"), F.col("f.id").alias("id"))


def write_profile(profile: DataFrame, path: str) -> None:
    """Partitioned by role; the roles written replace their old profiles alone."""
    profile.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("role").parquet(path)
