"""A stream gives what the batch gives on the same files."""

from pyspark.sql import functions as F

from sonorel.operators import profile as P
from sonorel.streaming import records


def finish(df, spark, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_frames_arrive_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ndjson").write_text('{"id":"a","kind":"text"}\n{"id":"b","kind":"text"}\n{"id":"a","kind":"text"}\n')
    got = finish(records.once_each(records.read_frames(spark, str(tmp_path / "in"))), spark, "frames_once")
    assert sorted(r.id for r in got.collect()) == ["a", "b"]


def test_windows_equal_batch(spark, data, tmp_path):
    batch = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "ev"))
    got = finish(records.event_power(stream, "3 days", "1 day", "40 days"), spark, "power", "complete")
    want = batch.groupBy(F.window("ts", "3 days", "1 day"), "event_type").agg(
        F.count("*").alias("n"),
        F.avg(F.col("value") * F.col("value")).alias("power"),
    )
    key = lambda d: sorted((str(r.window.start), r.event_type, r.n, round(r.power, 6)) for r in d.collect())
    assert key(got) == key(want)


def test_live_scores_equal_batch(spark, tmp_path):
    rows = [("r", "k", float(i), i) for i in range(30)]
    f = spark.createDataFrame(rows, "role string, key string, value double, id int")
    profile = P.build_profile(f)
    f.write.parquet(str(tmp_path / "f"))
    got = finish(records.live_axes(spark.readStream.schema(f.schema).parquet(str(tmp_path / "f")), profile), spark, "axes")
    assert sorted(map(tuple, got.select("id", "z", "band").collect())) == sorted(
        map(tuple, P.score_axes(f, profile, ["role", "key"]).select("id", "z", "band").collect())
    )
