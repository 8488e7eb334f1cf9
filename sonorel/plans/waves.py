"""Signals and time series: embeddings as signals of 64 samples, events as one series per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonorel.operators import series as S
from sonorel.operators import vectors as V
from sonorel.plans.tables import read

RATE = 6400
PEAK = 0.25


def _signals(spark: SparkSession, d: str) -> DataFrame:
    a = S.doubles(F.col("embedding"))
    return read(spark, d, "embeddings").select("vec_id", a.alias("a")).select(
        "vec_id",
        "a",
        F.slice("a", 1, 32).alias("l"),
        F.slice("a", 33, 32).alias("r"),
    )


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).select(F.col("vec_id").alias("series"), F.posexplode("a").alias("i", "x"))


def _series(spark: SparkSession, d: str) -> DataFrame:
    """series, i (from 0), x: each user's events in order."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return read(spark, d, "events").select(
        F.col("user_id").alias("series"),
        n.alias("i"),
        (F.col("value") / 100).alias("x"),
        "event_type",
        "ts",
    )


_SIG = "sig AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings), lr AS (SELECT vec_id, a, a[1:32] AS l, a[33:64] AS r FROM sig)"
_SMP = f"{_SIG}, smp AS (SELECT vec_id AS series, unnest(range(64)) AS i, unnest(a) AS x FROM sig)"
_SER = "ser AS (SELECT user_id AS series, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value / 100 AS x, event_type, ts FROM events)"
_PW = "list_sum(list_transform({0}, lambda x: x * x)) / len({0})"


def peak_rms(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).select(
        "vec_id",
        F.round(S.db(S.peak(F.col("a"))), 6).alias("peak_db"),
        F.round(S.db(F.sqrt(S.power(F.col("a")))), 6).alias("rms_db"),
    )


def dc_offset(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).select("vec_id", F.round(S.db(F.abs(S.mean(F.col("a")))), 5).alias("dc_db"))


def phase_corr(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).select("vec_id", F.round(S.correlation(F.col("l"), F.col("r")), 6).alias("corr"))


def mono_collapse(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).select("vec_id", S.collapse_penalty(F.col("l"), F.col("r")).alias("penalty_db"))


def width_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).select("vec_id", S.side_mid_ratio(F.col("l"), F.col("r")).alias("ratio"))


def _digest(a):
    weighted = F.aggregate(F.transform(a, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return F.round(weighted, 6)


def gain(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).select("vec_id", _digest(S.gain(F.col("a"), -6.0)).alias("y"))


def reverse(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).select("vec_id", _digest(F.reverse("a")).alias("y"))


def crop(spark: SparkSession, d: str) -> DataFrame:
    y = S.crop(F.col("a"), 10 / RATE, 30 / RATE, RATE)
    return _signals(spark, d).select("vec_id", F.size(y).alias("n"), _digest(y).alias("y"))


def fade(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d).select("vec_id", _digest(S.fade(F.col("a"), 8, 16)).alias("y"))


def pan(spark: SparkSession, d: str) -> DataFrame:
    left, right = S.pan(F.col("a"), F.lit(0.5))
    return _signals(spark, d).select("vec_id", _digest(left).alias("left"), _digest(right).alias("right"))


def automate_gain(spark: SparkSession, d: str) -> DataFrame:
    y = F.transform("a", lambda x, i: x * S.modulator(i.cast("double"), 16.0, "tri", 0.8))
    return _signals(spark, d).select("vec_id", _digest(y).alias("y"))


def limit_gain(spark: SparkSession, d: str) -> DataFrame:
    peak = S.db(S.peak(F.col("a")))
    return _signals(spark, d).select(
        "vec_id",
        F.round(S.limit_gain_db(peak, -8.0), 6).alias("limit_db"),
        F.round(S.normalize_gain_db(S.db(F.sqrt(S.power(F.col("a")))), peak, -14.0, -6.0), 6).alias("normalize_db"),
    )


def gate(spark: SparkSession, d: str) -> DataFrame:
    g = S.gated(_series(spark, d), 6, -6.0)
    return g.groupBy("series").agg(F.count_if(F.col("y") == 0).alias("silenced"), F.round(F.sum("y"), 6).alias("y"))


def lookahead_min(spark: SparkSession, d: str) -> DataFrame:
    return S.lookahead_min(_series(spark, d), 5).select("series", "i", F.round("least", 6).alias("least"))


def clicks(spark: SparkSession, d: str) -> DataFrame:
    return S.click_candidates(_series(spark, d), times=2.0).select("series", "i", F.round("d", 6).alias("d"))


def gaps(spark: SparkSession, d: str) -> DataFrame:
    return S.gaps(_series(spark, d), PEAK, 2)


def _framed(spark: SparkSession, d: str) -> DataFrame:
    return S.frames_of(_series(spark, d).withColumn("r", F.col("i")), 8, 4)


def framed_rms(spark: SparkSession, d: str) -> DataFrame:
    return _framed(spark, d).select("series", "frame", F.round("rms", 6).alias("rms"))


def snr(spark: SparkSession, d: str) -> DataFrame:
    return S.snr_db(_framed(spark, d))


def env_swing(spark: SparkSession, d: str) -> DataFrame:
    return S.swing_db(_framed(spark, d))


def silence_pct(spark: SparkSession, d: str) -> DataFrame:
    return S.silence_pct(_framed(spark, d), 6.0)


def short_term_max(spark: SparkSession, d: str) -> DataFrame:
    return S.short_term_max(_series(spark, d), "3 days", "1 day", "series", "ts", "x")


def _spectrum(spark: SparkSession, d: str) -> DataFrame:
    return S.spectrum(_samples(spark, d), 64)


def dft_power(spark: SparkSession, d: str) -> DataFrame:
    return _spectrum(spark, d).select("series", "bin", F.round("power", 6).alias("power"))


def band_power(spark: SparkSession, d: str) -> DataFrame:
    bands = spark.createDataFrame(
        [("low", 0.0, 500.0), ("mid", 500.0, 1500.0), ("high", 1500.0, 4000.0)],
        "band string, lo double, hi double",
    )
    return S.band_levels(_spectrum(spark, d), bands, RATE / 64)


def spectral_shape(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c: (F.round(F.col(c) + 1e-7, 4) + 0.0).alias(c)
    return S.spectral_shape(_spectrum(spark, d), RATE / 64).select(
        "series",
        *map(r, ("centroid", "spread", "skewness", "kurtosis")),
        "rolloff",
        r("flatness_db"),
        r("crest"),
    )


def spectral_contrast(spark: SparkSession, d: str) -> DataFrame:
    return _spectrum(spark, d).groupBy("series").agg(
        F.round(10 * F.log10(F.percentile("power", 0.85) / F.percentile("power", 0.15)), 3).alias("contrast_db"),
        F.round(F.sqrt(F.max("power") / F.avg("power")), 4).alias("crest"),
    )


def one_pole(spark: SparkSession, d: str) -> DataFrame:
    return S.one_pole(_samples(spark, d), 0.3).select("series", "i", F.round("y", 6).alias("y"))


def onset_slices(spark: SparkSession, d: str) -> DataFrame:
    return S.regions(_series(spark, d).where("event_type = 'error'")).select("series", "n", "start", "end")


def envelope_align(spark: SparkSession, d: str) -> DataFrame:
    s = _series(spark, d)
    return S.aligned_median(s, s.where("event_type = 'error'"), 6)


def marker_points(spark: SparkSession, d: str) -> DataFrame:
    s = _series(spark, d).where("event_type = 'error'")
    return s.select(
        "series",
        F.round(F.col("i") / RATE, 6).alias("t"),
        F.col("i").cast("long").alias("sample"),
        F.concat(F.lit("onset-"), F.row_number().over(Window.partitionBy("series").orderBy("i")) - 1).alias("label"),
    )


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return V.query_index(V.build_index(v), v.where("id % 100 = 0"), 10)


def index_build(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return V.build_index(v).select("id", _digest(F.col("unit")).alias("unit"))


def vector_placement(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").groupBy(V.placement(F.col("embedding")).alias("place")).agg(F.count("*").alias("n"))


def _dig(a: str) -> str:
    return f"round(list_sum(list_transform({a}, lambda x, i: x * i)), 6)"


_K = "pow(10, -6.0 / 20)"
_FRM = f"{_SER}, fr AS (SELECT series, f AS frame, sqrt(avg(x * x)) AS rms FROM (SELECT series, x, unnest(range(greatest(0, floor((i - 8) / 4)::BIGINT + 1), floor(i / 4)::BIGINT + 1)) AS f FROM ser) GROUP BY series, f HAVING count(*) = 8)"
_DFT = f"{_SMP}, spec AS (SELECT series, k AS bin, sum(x * cos(2 * pi() * ((k * i) % 64) / 64)) AS re, sum(x * sin(2 * pi() * ((k * i) % 64) / 64)) AS im FROM smp, range(33) b(k) GROUP BY series, k), pw AS (SELECT series, bin, re * re + im * im AS power FROM spec)"
SQL = {
    "peak_rms": f"WITH {_SIG} SELECT vec_id, round(20 * log10(list_max(list_transform(a, lambda x: abs(x)))), 6) AS peak_db, round(20 * log10(sqrt({_PW.format('a')})), 6) AS rms_db FROM sig",
    "dc_offset": f"WITH {_SIG} SELECT vec_id, round(20 * log10(abs(list_sum(a) / len(a))), 5) AS dc_db FROM sig",
    "phase_corr": f"WITH {_SIG}, x AS (SELECT vec_id, unnest(l) AS l, unnest(r) AS r FROM lr) SELECT vec_id, round(corr(l, r), 6) AS corr FROM x GROUP BY vec_id",
    "mono_collapse": f"WITH {_SIG}, x AS (SELECT vec_id, unnest(l) AS l, unnest(r) AS r FROM lr) SELECT vec_id, round(greatest(0, least(60, 10 * log10((avg(l * l) + avg(r * r)) / 2 / avg((l + r) * (l + r) / 4)))), 3) AS penalty_db FROM x GROUP BY vec_id",
    "width_ratio": f"WITH {_SIG}, x AS (SELECT vec_id, unnest(l) AS l, unnest(r) AS r FROM lr) SELECT vec_id, round(sqrt(avg((l - r) * (l - r) / 4)) / sqrt(avg((l + r) * (l + r) / 4)), 4) AS ratio FROM x GROUP BY vec_id",
    "gain": f"WITH {_SIG} SELECT vec_id, " + _dig(f"list_transform(a, lambda x: x * {_K})") + " AS y FROM sig",
    "reverse": f"WITH {_SIG} SELECT vec_id, " + _dig("list_reverse(a)") + " AS y FROM sig",
    "crop": f"WITH {_SIG} SELECT vec_id, 20 AS n, " + _dig("a[11:30]") + " AS y FROM sig",
    "fade": f"WITH {_SIG} SELECT vec_id, " + _dig(
        "list_transform(a, lambda x, i: x * least(1.0, (i - 1) / 8.0::DOUBLE, (64 - i) / 16.0::DOUBLE))"
    ) + " AS y FROM sig",
    "pan": f"WITH {_SIG} SELECT vec_id, " + _dig(
        "list_transform(a, lambda x: x * cos(1.5 * pi() / 4))"
    ) + " AS left, " + _dig("list_transform(a, lambda x: x * sin(1.5 * pi() / 4))") + " AS right FROM sig",
    "automate_gain": f"WITH {_SIG} SELECT vec_id, " + _dig(
        "list_transform(a, lambda x, i: x * (1 - 0.8::DOUBLE + 0.8::DOUBLE * (1 - abs(2 * ((i - 1) / 16.0::DOUBLE - floor((i - 1) / 16.0::DOUBLE)) - 1))))"
    ) + " AS y FROM sig",
    "limit_gain": f"WITH {_SIG}, p AS (SELECT vec_id, 20 * log10(list_max(list_transform(a, lambda x: abs(x)))) AS pk, 20 * log10(sqrt({_PW.format('a')})) AS rms FROM sig) SELECT vec_id, round(least(0, -8 - pk), 6) AS limit_db, round(least(-14 - rms, -6 - pk), 6) AS normalize_db FROM p",
    "gate": f"WITH {_SER}, g AS (SELECT series, CASE WHEN avg(x * x) OVER (PARTITION BY series ORDER BY i ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) >= pow(10, -0.6) THEN x ELSE 0 END AS y FROM ser) SELECT series, count(*) FILTER (WHERE y = 0) AS silenced, round(sum(y), 6) AS y FROM g GROUP BY series",
    "lookahead_min": f"WITH {_SER}, r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY i DESC) AS rest FROM ser) SELECT a.series, a.i, round(least(min(a.x) OVER (PARTITION BY a.series ORDER BY a.i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), coalesce((SELECT min(b.x) FROM r b WHERE b.series = a.series AND a.rest < 5 AND b.rest <= 5 - a.rest), 'infinity'::DOUBLE)), 6) AS least FROM r a",
    "clicks": f"WITH {_SER}, q AS (SELECT series, i, abs(x - 2 * lag(x, 1) OVER w + lag(x, 2) OVER w) AS d FROM ser WINDOW w AS (PARTITION BY series ORDER BY i)), m AS (SELECT series, median(d) AS m FROM q GROUP BY series), v AS (SELECT series, median(abs(d - m)) AS mad FROM q JOIN m USING (series) GROUP BY series) SELECT series, i, round(d, 6) AS d FROM q JOIN m USING (series) JOIN v USING (series) WHERE d > m + 2 * mad AND d > 0.05",
    "gaps": f"WITH {_SER}, q AS (SELECT series, i, abs(x) < {PEAK} AS quiet, max(i) OVER (PARTITION BY series) AS last FROM ser), g AS (SELECT *, i - row_number() OVER (PARTITION BY series, quiet ORDER BY i) AS isl FROM q) SELECT series, min(i) AS start, count(*) AS n FROM g WHERE quiet GROUP BY series, isl, last HAVING count(*) >= 2 AND min(i) > 0 AND max(i) < last",
    "framed_rms": f"WITH {_FRM} SELECT series, frame, round(rms, 6) AS rms FROM fr",
    "snr": f"WITH {_FRM}, q AS (SELECT series, quantile_cont(rms, 0.05) AS lo, quantile_cont(rms, 0.9) AS hi FROM fr GROUP BY series) SELECT series, round(least(120, 20 * log10(max(hi) / median(rms))), 1) AS snr_db FROM fr JOIN q USING (series) WHERE rms <= lo GROUP BY series",
    "env_swing": f"WITH {_FRM}, d AS (SELECT series, 20 * log10(rms) AS db FROM fr WHERE rms > 0), t AS (SELECT series, max(db) AS top FROM d GROUP BY series) SELECT series, round(quantile_cont(db, 0.9) - quantile_cont(db, 0.1), 3) AS swing_db FROM d JOIN t USING (series) WHERE db >= top - 60 GROUP BY series",
    "silence_pct": f"WITH {_FRM}, t AS (SELECT series, max(rms) AS top FROM fr GROUP BY series) SELECT series, round(100.0::DOUBLE * count(*) FILTER (WHERE rms < top * pow(10, -0.3)) / count(*), 2) AS silence_pct FROM fr JOIN t USING (series) GROUP BY series",
    "short_term_max": f"WITH {_SER}, w AS (SELECT series, date_trunc('day', ts) - to_days(unnest([0, 1, 2])::INTEGER) AS s, x FROM ser), p AS (SELECT series, s, avg(x * x) AS p FROM w GROUP BY series, s) SELECT series, round(max(p), 6) AS max_power FROM p GROUP BY series",
    "dft_power": f"WITH {_DFT} SELECT series, bin, round(power, 6) AS power FROM pw",
    "band_power": f"WITH {_DFT}, b AS (SELECT series, CASE WHEN bin * 100.0 < 500 THEN 'low' WHEN bin * 100.0 < 1500 THEN 'mid' ELSE 'high' END AS band, power, sum(power) OVER (PARTITION BY series) AS whole FROM pw) SELECT series, band, round(10 * log10(sum(power) / max(whole)), 3) AS level_db FROM b GROUP BY series, band",
    "spectral_shape": f"WITH {_DFT}, m AS (SELECT series, bin, bin * 100.0::DOUBLE AS hz, sqrt(power) AS mag, power FROM pw), s AS (SELECT series, sum(mag) AS sm, sum(mag * hz) / sum(mag) AS c, exp(avg(ln(greatest(power, 1e-10)))) AS geo, avg(greatest(power, 1e-10)) AS ari, max(mag) / avg(mag) AS crest FROM m GROUP BY series), q AS (SELECT series, sqrt(sum(mag / sm * pow(hz - c, 2))) AS spread, sum(mag / sm * pow(hz - c, 3)) AS m3, sum(mag / sm * pow(hz - c, 4)) AS m4 FROM m JOIN s USING (series) GROUP BY series), u AS (SELECT series, hz, sum(mag) OVER (PARTITION BY series ORDER BY bin) AS cum FROM m), o AS (SELECT series, min(hz) AS rolloff FROM u JOIN s USING (series) WHERE cum >= 0.85 * sm - 1e-12 GROUP BY series) SELECT series, round(round(c, 6) + 1e-7, 4) + 0.0 AS centroid, round(round(spread, 6) + 1e-7, 4) + 0.0 AS spread, round(round(m3 / pow(spread, 3), 6) + 1e-7, 4) + 0.0 AS skewness, round(round(m4 / pow(spread, 4), 6) + 1e-7, 4) + 0.0 AS kurtosis, rolloff, round(round(10 * log10(geo / ari), 6) + 1e-7, 4) + 0.0 AS flatness_db, round(round(crest, 6) + 1e-7, 4) + 0.0 AS crest FROM s JOIN q USING (series) JOIN o USING (series)",
    "spectral_contrast": f"WITH {_DFT} SELECT series, round(10 * log10(quantile_cont(power, 0.85) / quantile_cont(power, 0.15)), 3) AS contrast_db, round(sqrt(max(power) / avg(power)), 4) AS crest FROM pw GROUP BY series",
    "one_pole": f"WITH {_SMP} SELECT a.series, a.i, round(sum(0.3::DOUBLE * pow(0.7::DOUBLE, a.i - b.i) * b.x), 6) AS y FROM smp a JOIN smp b ON a.series = b.series AND b.i <= a.i GROUP BY a.series, a.i",
    "onset_slices": f"WITH {_SER} SELECT series, row_number() OVER w - 1 AS n, i AS start, lead(i) OVER w AS end FROM ser WHERE event_type = 'error' WINDOW w AS (PARTITION BY series ORDER BY i)",
    "envelope_align": f"WITH {_SER}, o AS (SELECT series, i AS start, least(coalesce(lead(i) OVER (PARTITION BY series ORDER BY i), i + 6), i + 6) AS stop FROM ser WHERE event_type = 'error') SELECT s.series, s.i - o.start AS offset, round(median(abs(x)), 6) AS level FROM ser s JOIN o ON s.series = o.series AND s.i >= o.start AND s.i < o.stop GROUP BY 1, 2",
    "marker_points": f"WITH {_SER} SELECT series, round(i / {RATE}.0::DOUBLE, 6) AS t, i AS sample, 'onset-' || (row_number() OVER (PARTITION BY series ORDER BY i) - 1) AS label FROM ser WHERE event_type = 'error'",
    "cosine_topk": "WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(list_transform(q.embedding, lambda x: x::DOUBLE), list_transform(v.embedding, lambda x: x::DOUBLE)), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0) SELECT query_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10",
    "index_build": f"WITH {_SIG}, n AS (SELECT vec_id, a, sqrt(list_sum(list_transform(a, lambda x: x * x))) AS k FROM sig) SELECT vec_id AS id, round(list_sum(list_transform(a, lambda x, i: x * i)) / k, 6) AS unit FROM n",
    "vector_placement": "SELECT CASE WHEN len(embedding) <= 64 THEN 'inline' ELSE 'blob' END AS place, count(*) AS n FROM embeddings GROUP BY 1",
}
QUERIES = {name: globals()[name] for name in SQL}
