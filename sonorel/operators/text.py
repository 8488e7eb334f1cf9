"""Captions, cues, step patterns and note lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SNIPPET, POINTS, IMAGES = 200, 5, 64


def snippet(text: Column, most: int = SNIPPET) -> Column:
    """The text on one line, cut with an ellipsis."""
    line = F.regexp_replace(text, "\n", " ")
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)


def clock(seconds: Column, kind: str) -> Column:
    """A time stamp of the format: srt, vtt (milliseconds) or lrc (hundredths)."""
    if kind == "lrc":
        cs = F.round(seconds * 100).cast("long")
        return F.format_string("[%02d:%02d.%02d]", F.floor(cs / 6000).cast("long"), F.floor(cs / 100).cast("long") % 60, cs % 100)
    ms = F.round(seconds * 1000).cast("long")
    mark = "," if kind == "srt" else "."
    return F.format_string(
        f"%02d:%02d:%02d{mark}%03d",
        F.floor(ms / 3_600_000).cast("long"),
        F.floor(ms / 60_000).cast("long") % 60,
        F.floor(ms / 1000).cast("long") % 60,
        ms % 1000,
    )


SEGMENTS = "array<struct<start:double,end:double,text:string,words:array<struct<start:double,end:double,word:string>>>>"


def transcript_points(transcripts: DataFrame) -> DataFrame:
    """of, role (segment or word), t, sample, dur, label, of transcripts: of, sr, segments (as SEGMENTS).

    A segment without start begins at 0, a word without one where its segment does; what has no end ends where it starts."""
    each = transcripts.select("of", "sr", F.explode("segments").alias("s"))
    begin = F.coalesce("s.start", F.lit(0.0))
    each = each.select("of", "sr", "s", begin.alias("begin"))

    def points(df: DataFrame, role: str, t: Column, end: Column, label: Column) -> DataFrame:
        dur = F.greatest(F.lit(0.0), F.coalesce(end, t) - t)
        return df.select(
            "of",
            F.lit(role).alias("role"),
            t.alias("t"),
            F.rint(t * F.col("sr")).cast("bigint").alias("sample"),
            dur.alias("dur"),
            F.trim(F.coalesce(label, F.lit(""))).alias("label"),
        )

    words = each.select("of", "sr", "begin", F.explode("s.words").alias("w"))
    segment = points(each, "segment", F.col("begin"), F.col("s.end"), F.col("s.text"))
    return segment.unionByName(points(words, "word", F.coalesce("w.start", "begin"), F.col("w.end"), F.col("w.word")))


def collect_cues(frames: DataFrame, by: list[str]) -> DataFrame:
    """by..., t, dur, label: the points of a stream's segment markers, or else of its word markers; where these name
    nothing, the whole of its last lyrics or caption. frames: schema.FRAME and by."""
    marks = frames.where("kind = 'marker' and role in ('segment', 'word')").select(
        *by,
        (F.col("role") == "segment").alias("segment"),
        F.from_json("data", "array<struct<t:double,dur:double,label:string>>").alias("points"),
    )
    best = marks.groupBy(*by).agg(F.max("segment").alias("segment"))
    some = marks.join(best, [*by, "segment"]).select(*by, F.explode("points").alias("p"))
    timed = some.select(
        *by,
        F.coalesce("p.t", F.lit(0.0)).alias("t"),
        F.coalesce("p.dur", F.lit(0.0)).alias("dur"),
        F.trim(F.coalesce("p.label", F.lit(""))).alias("label"),
    ).where("label <> ''")
    texts = frames.where(
        "kind = 'text' and role in ('lyrics', 'caption')"
    ).groupBy(*by).agg(F.max_by("data", "pos").alias("label"))
    whole = texts.join(timed.select(*by).distinct(), by, "left_anti").select(
        *by,
        F.lit(0.0).alias("t"),
        F.lit(0.0).alias("dur"),
        F.trim("label").alias("label"),
    )
    return timed.unionByName(whole.where("label <> ''"))


def cue_lines(cues: DataFrame, by: list[str], kind: str) -> DataFrame:
    """by..., n, line: numbered cues in order of time. Blank labels go; a cue that doesn't end after it starts lasts two seconds."""
    some = cues.where(F.trim("label") != "")
    n = F.row_number().over(Window.partitionBy(*by).orderBy("t", "label"))
    end = F.when(F.col("dur") > 0, F.col("t") + F.col("dur")).otherwise(F.col("t") + 2.0)
    if kind == "lrc":
        line = F.concat(clock(F.col("t"), kind), F.col("label"))
    else:
        span = F.concat(clock(F.col("t"), kind), F.lit(" --> "), clock(end, kind))
        line = F.concat(F.col("n").cast("string"), F.lit("\n"), span, F.lit("\n"), F.col("label"))
    return some.withColumn("n", n).withColumn("end", end).select(*by, F.col("n").cast("long").alias("n"), line.alias("line"))


def subtitle(lines: DataFrame, by: list[str], kind: str) -> DataFrame:
    """by..., text: the whole file of each track."""
    sep, head = ("\n", "") if kind == "lrc" else ("\n\n", "WEBVTT\n\n" if kind == "vtt" else "")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])
    return lines.groupBy(*by).agg(F.concat(F.lit(head), F.array_join(ordered, sep), F.lit("\n")).alias("text"))


def caption(
    dur: Column,
    sr: Column,
    ch: Column,
    lufs: Column,
    clipping: Column,
    correlation: Column,
    lossy: Column,
    snr: Column,
) -> Column:
    """One line on a signal, with the quality flags that it raises."""
    layout = F.when(ch == 1, "mono").when(ch == 2, "stereo").otherwise(F.concat(ch.cast("string"), F.lit(" ch")))
    flags = F.array_compact(
        F.array(
            F.when(clipping, F.lit("clipping")),
            F.when(correlation < 0, F.lit("phase")),
            F.when(lossy >= 0.5, F.lit("lossy source")),
            F.when(snr < 20, F.lit("noisy")),
        )
    )
    qc = F.when(F.size(flags) > 0, F.array_join(flags, ", ")).otherwise("clean")
    loud = F.when(
        lufs.isNotNull(),
        F.concat(F.lit("; "), F.format_string("%.1f", lufs.cast("double")), F.lit(" LUFS")),
    ).otherwise("")
    return F.concat(
        F.format_string("%.2f", dur.cast("double")),
        F.lit(" s, "),
        sr.cast("string"),
        F.lit(" Hz, "),
        layout,
        loud,
        F.lit("; QC: "),
        qc,
    )


def velocity_db(velocity: Column) -> Column:
    """Level of a hit; null for a rest."""
    return F.when(velocity > 0, F.greatest(F.lit(-40.0), F.least(F.lit(0.0), 20 * F.log10(velocity))))


def bar_beat(beat: Column, per_bar: int = 4) -> Column:
    """bar.beat.thousandths, from 1."""
    return F.format_string(
        "%d.%d.%03d",
        (F.floor(beat / per_bar) + 1).cast("long"),
        (F.floor(beat - per_bar * F.floor(beat / per_bar)) + 1).cast("long"),
        F.round((beat - F.floor(beat)) * 1000).cast("long"),
    )


def expand_pattern(hits: DataFrame, bars: int, grid: int = 16, per_bar: int = 4, swing: float = 0.0) -> DataFrame:
    """A row for each hit and bar in which it sounds. hits: track, source, step (from 1), velocity, gain_db, bars (null: all); if there, nudge (beats), pitch and track_pitch (semitones).

    Rests make no row; swing delays even steps by a share of a step; nudge moves any hit, not before the start; an explicit gain is kept within -60 and 24 dB; a hit without pitch takes its track's, or 0."""
    wrong = F.when(
        (F.col("step") < 1) | (F.col("step") > grid),
        F.raise_error(F.concat(F.lit("step out of range: "), F.col("step").cast("string"))),
    )
    checked = hits.where(wrong.isNull())
    each = checked.withColumn("bar", F.explode(F.sequence(F.lit(1), F.lit(bars)))).where(
        F.col("bars").isNull() | F.array_contains(F.col("bars"), F.col("bar"))
    )
    step = per_bar / grid
    given = lambda *names: F.coalesce(*[F.col(c).cast("double") for c in names if c in hits.columns], F.lit(0.0))
    beat = (F.col("bar") - 1) * per_bar + (F.col("step") - 1) * F.lit(step) + F.when(
        F.col("step") % 2 == 0,
        F.lit(swing * step),
    ).otherwise(0.0) + given("nudge")
    level = F.when(
        F.col("gain_db").isNotNull(),
        F.greatest(F.lit(-60.0), F.least(F.lit(24.0), F.col("gain_db"))),
    ).otherwise(velocity_db(F.col("velocity")))
    return each.where("velocity > 0").withColumns(
        {"beat": F.greatest(F.lit(0.0), beat), "gain_db": level, "pitch": given("pitch", "track_pitch")}
    ).withColumn("at", bar_beat(F.col("beat"), per_bar))


def midi_events(notes: DataFrame, by: list[str], most: int = 512) -> DataFrame:
    """The first notes of each stream by (start, pitch); longer lists belong in a blob."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("start", "pitch"))
    return notes.withColumn("place", place.cast("long")).where(F.col("place") <= most)
