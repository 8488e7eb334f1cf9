"""Signals and time series in SQL expressions.

Short signals are arrays (one row per signal); long ones are rows (series, i, x)
ordered by i within their series, and windows partition by series.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOOR_DB = -120.0


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a).cast("double"))


def power(a: Column) -> Column:
    return mean(F.transform(a, lambda x: x * x))


def db(ratio: Column, per: float = 20.0) -> Column:
    """Null where there is nothing to take a logarithm of."""
    return F.when(ratio > 0, per * F.log10(ratio))


def peak(a: Column) -> Column:
    return F.array_max(F.transform(a, lambda x: F.abs(x)))


def doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def dc_offset_db(a: Column) -> Column:
    return F.round(db(F.abs(mean(a))), 2)


def correlation(left: Column, right: Column) -> Column:
    """Pearson's, within -1 and 1; null where a channel doesn't move."""
    ml, mr = mean(left), mean(right)
    dl, dr = F.transform(left, lambda x: x - ml), F.transform(right, lambda x: x - mr)
    over = F.sqrt(total(F.transform(dl, lambda x: x * x)) * total(F.transform(dr, lambda x: x * x)))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(over > 0, total(F.zip_with(dl, dr, lambda a, b: a * b)) / over)))


def collapse_penalty(left: Column, right: Column) -> Column:
    """Loss in dB when two channels become one, from 0 to 60; 60 where they cancel."""
    channels = (power(left) + power(right)) / 2
    mono = power(F.zip_with(left, right, lambda a, b: (a + b) / 2))
    return F.round(
        F.when(channels <= 1e-20, 0.0).when(mono <= 1e-20, 60.0).otherwise(
            F.greatest(F.lit(0.0), F.least(F.lit(60.0), 10 * F.log10(channels / mono)))
        ),
        3,
    )


def side_mid_ratio(left: Column, right: Column) -> Column:
    side, mid = F.zip_with(left, right, lambda a, b: (a - b) / 2), F.zip_with(left, right, lambda a, b: (a + b) / 2)
    return F.round(F.try_divide(F.sqrt(power(side)), F.sqrt(power(mid))), 4)


def gain(a: Column, decibels: Column | float) -> Column:
    k = F.pow(F.lit(10.0), (F.lit(decibels) if isinstance(decibels, (int, float)) else decibels) / 20)
    return F.transform(a, lambda x: x * k)


def crop(a: Column, start: float, end: float | None, rate: int) -> Column:
    first = F.lit(max(0, round(start * rate)))
    last = F.size(a) if end is None else F.least(F.size(a), F.lit(round(end * rate)))
    return F.slice(a, first + 1, F.greatest(F.lit(0), last - first))


def fade(a: Column, attack: int, release: int) -> Column:
    """Linear in over `attack` samples, and out over `release`."""
    n = F.size(a)
    return F.transform(
        a,
        lambda x, i: x * F.least(
            F.lit(1.0),
            F.lit(1.0) if attack == 0 else i / F.lit(float(attack)),
            F.lit(1.0) if release == 0 else (n - 1 - i) / F.lit(float(release)),
        ),
    )


def modulator(i: Column, period: float, shape: str = "sine", depth: float = 1.0, phase: float = 0.0, duty: float = 0.5) -> Column:
    """0..1 at sample i."""
    turn = i / F.lit(period) + F.lit(phase)
    t = turn - F.floor(turn)
    wave = {
        "sine": 0.5 + 0.5 * F.sin(2 * F.pi() * t),
        "tri": 1 - F.abs(2 * t - 1),
        "saw-up": t,
        "saw-down": 1 - t,
        "square": F.when(t < duty, 1.0).otherwise(0.0),
    }[shape]
    return (1 - F.lit(depth)) + F.lit(depth) * wave


def pan(a: Column, position: Column) -> tuple[Column, Column]:
    """Left and right at constant power; position from -1 to 1."""
    angle = (position + 1) * F.pi() / 4
    return F.transform(a, lambda x: x * F.cos(angle)), F.transform(a, lambda x: x * F.sin(angle))


def limit_gain_db(true_peak_db: Column, ceiling: float = -1.0) -> Column:
    return F.least(F.lit(0.0), F.lit(ceiling) - true_peak_db)


def normalize_gain_db(lufs: Column, true_peak_db: Column, target: float, ceiling: float | None = -1.0) -> Column:
    """The gain to a loudness, held back so that the peak stays under the ceiling; null for silence."""
    wanted = F.lit(target) - lufs
    return wanted if ceiling is None else F.least(wanted, F.lit(ceiling) - true_peak_db)


def ordered(by: str = "series", at: str = "i") -> Window:
    return Window.partitionBy(by).orderBy(at)


def gated(df: DataFrame, window: int, threshold_db: float, by: str = "series", at: str = "i", x: str = "x") -> DataFrame:
    """x is silenced where the mean square over the window around it is below the threshold."""
    half = window // 2
    level = F.avg(F.col(x) * F.col(x)).over(ordered(by, at).rowsBetween(-half, window - half - 1))
    return df.withColumn("y", F.when(level >= F.lit(10.0 ** (threshold_db / 10)), F.col(x)).otherwise(0.0))


def lookahead_min(df: DataFrame, n: int, by: str = "series", at: str = "i", x: str = "x") -> DataFrame:
    """least: the smallest x here and over the n - 1 next samples; past the end the series is mirrored, as limiters see it."""
    w = ordered(by, at)
    back = Window.partitionBy(by).orderBy(F.desc(at))
    rest = F.row_number().over(back)  # 1 at the last sample
    ahead = F.min(x).over(w.rowsBetween(Window.currentRow, n - 1))
    d = df.withColumns({"_rest": rest, "_ahead": ahead})
    # What is mirrored in are the last n - _rest samples of the series.
    ends = F.collect_list(F.when(F.col("_rest") <= n, F.struct("_rest", F.col(x).alias("x")))).over(Window.partitionBy(by))
    mirrored = F.array_min(F.transform(F.filter(ends, lambda s: s["_rest"] <= n - F.col("_rest")), lambda s: s["x"]))
    return d.withColumn(
        "least",
        F.when(F.col("_rest") < n, F.least("_ahead", mirrored)).otherwise(F.col("_ahead")),
    ).drop("_rest", "_ahead")


def second_difference(by: str = "series", at: str = "i", x: str = "x") -> Column:
    w = ordered(by, at)
    return F.col(x) - 2 * F.lag(x, 1).over(w) + F.lag(x, 2).over(w)


def click_candidates(
    df: DataFrame,
    times: float = 12.0,
    least: float = 0.05,
    by: str = "series",
    at: str = "i",
    x: str = "x",
) -> DataFrame:
    """Places whose second difference stands out from the series' median by many median deviations."""
    d = df.withColumn("d", F.abs(second_difference(by, at, x))).where("d is not null")
    m = d.groupBy(by).agg(F.median("d").alias("m"))
    d = d.join(m, by).withColumn("apart", F.abs(F.col("d") - F.col("m")))
    mad = d.groupBy(by).agg(F.median("apart").alias("mad"))
    return d.join(mad, by).where((F.col("d") > F.col("m") + times * F.col("mad")) & (F.col("d") > least)).select(by, at, "d")


def gaps(df: DataFrame, threshold: float, least: int, by: str = "series", at: str = "i", x: str = "x") -> DataFrame:
    """Runs of at least `least` samples below the threshold with sound on either side: by, start, n."""
    w = ordered(by, at)
    d = df.select(by, at, (F.abs(x) < threshold).alias("quiet"), F.row_number().over(w).alias("r"))
    d = d.withColumn("island", F.col("r") - F.row_number().over(Window.partitionBy(by, "quiet").orderBy(at)))
    d = d.withColumns({"first": F.min("r").over(Window.partitionBy(by)), "last": F.max("r").over(Window.partitionBy(by))})
    runs = d.where("quiet").groupBy(by, "island").agg(
        F.min(at).alias("start"),
        F.count("*").alias("n"),
        F.min("r").alias("a"),
        F.max("r").alias("b"),
        F.first("first").alias("first"),
        F.first("last").alias("last"),
    )
    return runs.where(
        (F.col("n") >= least) & (F.col("a") > F.col("first")) & (F.col("b") < F.col("last"))
    ).select(by, "start", "n")


def frames_of(df: DataFrame, size: int, hop: int, by: str = "series", x: str = "x") -> DataFrame:
    """by, frame, rms of whole frames. Samples are numbered from 0 in column r; each goes to all frames that cover it."""
    last = F.floor(F.col("r") / hop)
    first = F.greatest(F.lit(0), F.floor((F.col("r") - size) / hop) + 1)
    each = df.select(by, x, F.explode(F.sequence(first, last)).alias("frame"))
    return each.groupBy(by, "frame").agg(
        F.sqrt(F.avg(F.col(x) * F.col(x))).alias("rms"),
        F.count("*").alias("n"),
    ).where(F.col("n") == size).select(by, "frame", "rms")


def snr_db(frames: DataFrame, by: str = "series", most: float = 120.0) -> DataFrame:
    """Loud frames (90th percentile) against the quietest (median of those up to the 5th)."""
    q = frames.groupBy(by).agg(F.percentile("rms", F.array(F.lit(0.05), F.lit(0.9))).alias("q"))
    noise = frames.join(q, by).where(F.col("rms") <= F.col("q")[0]).groupBy(by).agg(
        F.median("rms").alias("noise"),
        F.max(F.col("q")[1]).alias("loud"),
    )
    return noise.select(
        by,
        F.round(
            F.when(F.col("noise") <= 0, most).otherwise(F.least(F.lit(most), 20 * F.log10(F.col("loud") / F.col("noise")))),
            1,
        ).alias("snr_db"),
    )


def swing_db(frames: DataFrame, by: str = "series", below: float = 60.0) -> DataFrame:
    """Spread (90th to 10th percentile, dB) of frames within 60 dB of the loudest."""
    d = frames.where("rms > 0").withColumn("db", 20 * F.log10("rms"))
    top = d.groupBy(by).agg(F.max("db").alias("top"))
    return d.join(top, by).where(F.col("db") >= F.col("top") - below).groupBy(by).agg(
        F.round(F.percentile("db", 0.9) - F.percentile("db", 0.1), 3).alias("swing_db")
    )


def silence_pct(frames: DataFrame, below: float = 60.0, by: str = "series") -> DataFrame:
    top = frames.groupBy(by).agg(F.max("rms").alias("top"))
    quiet = F.col("rms") < F.col("top") * F.lit(10.0 ** (-below / 20))
    return frames.join(top, by).groupBy(by).agg(F.round(100.0 * F.count_if(quiet) / F.count("*"), 2).alias("silence_pct"))


def short_term_max(df: DataFrame, length: str, hop: str, by: str, at: str, x: str) -> DataFrame:
    """The largest mean square of any sliding window of time."""
    w = df.groupBy(by, F.window(at, length, hop).alias("w")).agg(F.avg(F.col(x) * F.col(x)).alias("p"))
    return w.groupBy(by).agg(F.round(F.max("p"), 6).alias("max_power"))


def spectrum(df: DataFrame, n: int, by: str = "series", x: str = "x", at: str = "i") -> DataFrame:
    """by, bin, power: the Fourier transform of n samples, a series at a time, by the fast algorithm. Samples that are absent are zero."""

    def run(key: tuple, own: pa.Table) -> pa.Table:
        v = np.zeros(n)
        place = own.column(at).to_numpy()
        inside = (place >= 0) & (place < n)
        v[place[inside]] = own.column(x).to_numpy()[inside]
        power = np.abs(np.fft.rfft(v)) ** 2
        return pa.table({by: pa.repeat(key[0], len(power)), "bin": pa.array(np.arange(len(power))), "power": pa.array(power)})

    kind = df.schema[by].dataType.simpleString()
    rows = df.select(F.col(by), F.col(at).cast("bigint").alias(at), F.col(x).cast("double").alias(x))
    return rows.groupBy(by).applyInArrow(run, f"`{by}` {kind}, bin bigint, power double")


def band_levels(power: DataFrame, bands: DataFrame, hz_per_bin: float, by: str = "series") -> DataFrame:
    """by, band, level_db: power in each band against the whole, no less than -120 dB."""
    p = power.withColumn("hz", F.col("bin") * hz_per_bin)
    whole = p.groupBy(by).agg(F.sum("power").alias("whole"))
    inside = p.join(
        F.broadcast(bands),
        (F.col("hz") >= F.col("lo")) & (F.col("hz") < F.col("hi")),
    ).groupBy(by, "band").agg(F.sum("power").alias("p"))
    return inside.join(whole, by).select(
        by,
        "band",
        F.round(
            F.when(F.col("p") / F.col("whole") > 1e-12, 10 * F.log10(F.col("p") / F.col("whole"))).otherwise(FLOOR_DB),
            3,
        ).alias("level_db"),
    )


def spectral_shape(power: DataFrame, hz_per_bin: float, by: str = "series") -> DataFrame:
    """Moments of the magnitude over frequency, rolloff, flatness, crest and slope of each series' spectrum."""
    m = power.select(by, "bin", (F.col("bin") * hz_per_bin).alias("hz"), F.sqrt("power").alias("mag"), "power")
    s = m.groupBy(by).agg(
        F.sum("mag").alias("sum"),
        (F.sum(F.col("mag") * F.col("hz")) / F.sum("mag")).alias("centroid"),
        F.exp(F.avg(F.log(F.greatest("power", F.lit(1e-10))))).alias("geo"),
        F.avg(F.greatest("power", F.lit(1e-10))).alias("arith"),
        (F.max("mag") / F.avg("mag")).alias("crest"),
        F.regr_slope("mag", "hz").alias("slope"),
    )
    d = m.join(s, by).withColumn("off", F.col("hz") - F.col("centroid"))
    w = F.col("mag") / F.col("sum")
    moments = d.groupBy(by).agg(
        F.sqrt(F.sum(w * F.col("off") ** 2)).alias("spread"),
        F.sum(w * F.col("off") ** 3).alias("m3"),
        F.sum(w * F.col("off") ** 4).alias("m4"),
    )
    share = F.sum("mag").over(Window.partitionBy(by).orderBy("bin"))
    roll = m.withColumn("cum", share).join(s.select(by, "sum"), by).where(
        F.col("cum") >= 0.85 * F.col("sum") - 1e-12
    ).groupBy(by).agg(F.min("hz").alias("rolloff"))
    r = lambda c, k=6: F.round(c, k)
    return s.join(moments, by).join(roll, by).select(
        by,
        r(F.col("centroid")).alias("centroid"),
        r(F.col("spread")).alias("spread"),
        r(F.try_divide("m3", F.col("spread") ** 3)).alias("skewness"),
        r(F.try_divide("m4", F.col("spread") ** 4)).alias("kurtosis"),
        r(F.col("rolloff")).alias("rolloff"),
        r(10 * F.log10(F.col("geo") / F.col("arith"))).alias("flatness_db"),
        r(F.col("crest")).alias("crest"),
        r(F.col("slope")).alias("slope"),
    )


def one_pole(df: DataFrame, a: float, by: str = "series", at: str = "i", x: str = "x") -> DataFrame:
    """y[n] = a * x[n] + (1 - a) * y[n - 1], in one pass over each series' samples, which meet in one task."""

    def run(key: tuple, own: pa.Table) -> pa.Table:
        own = own.sort_by(at)
        y = accumulate(own.column(x).to_pylist(), lambda last, v: a * v + (1 - a) * last, initial=0.0)
        return pa.table({by: own.column(by), at: own.column(at), "y": pa.array(list(y)[1:], pa.float64())})

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (by, at))
    return df.select(by, at, F.col(x).cast("double").alias(x)).groupBy(by).applyInArrow(run, f"{kinds}, y double")


def regions(onsets: DataFrame, by: str = "series", at: str = "i") -> DataFrame:
    """by, n, start, end (null: to the end): from each onset to the next."""
    w = ordered(by, at)
    return onsets.select(by, (F.row_number().over(w) - 1).alias("n"), F.col(at).alias("start"), F.lead(at).over(w).alias("end"))


def aligned_median(df: DataFrame, onsets: DataFrame, most: int, by: str = "series", at: str = "i", x: str = "x") -> DataFrame:
    """by, offset, level: the median over onsets of |x| at each offset from them, up to `most` or the next onset."""
    r = regions(onsets, by, at).withColumn("stop", F.least(F.coalesce("end", F.col("start") + most), F.col("start") + most))
    each = r.select(by, "start", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias(at)).where(F.col(at) < 1 << 62)
    return df.join(each, [by, at]).groupBy(
        by,
        (F.col(at) - F.col("start")).alias("offset"),
    ).agg(F.round(F.median(F.abs(x)), 6).alias("level"))
