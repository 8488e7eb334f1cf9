"""The measuring, editing and decoding kernels, over embeddings as signals of 64 samples and over made signals.

What the kernels give for the table's signals is computed again in SQL; for made signals the
SQL states the values that are published, or that follow from how the signal is made."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonorel.operators import edits as E
from sonorel.operators import features as M
from sonorel.operators import frames as FR
from sonorel.operators import images as I
from sonorel.operators import stages as T
from sonorel.plans.tables import read
from sonorel.sources import recipes as R
from sonorel.sources import wav

RATE = 6400


def _signals(spark: SparkSession, d: str, stereo: bool = False) -> DataFrame:
    """schema.SIGNAL: a channel of 64 samples, or two of 32."""
    a = F.col("embedding")
    pcm = F.array(F.slice(a, 1, 32), F.slice(a, 33, 32)) if stereo else F.array(a)
    return read(spark, d, "embeddings").select(
        F.col("vec_id").cast("string").alias("signal_id"),
        F.lit(RATE).alias("sr"),
        F.lit(2 if stereo else 1).alias("ch"),
        F.lit(32 if stereo else 64).alias("n"),
        pcm.alias("pcm"),
    )


def _digest(signals: DataFrame, *also: str) -> DataFrame:
    weighted = F.transform(F.col("pcm")[0], lambda x, i: x.cast("double") * (i + 1))
    total = F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x)
    return signals.select(F.col("signal_id").cast("bigint").alias("vec_id"), *also, F.round(total, 6).alias("y"))


def _files(spark: SparkSession, d: str, encoding: str) -> DataFrame:
    return wav.encoded(_signals(spark, d), encoding).withColumnRenamed("signal_id", "path")


def wav_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every signal to a file's bytes and back; the hash is of the samples, so equal signals share one."""
    back = wav.decoded(_files(spark, d, "FLOAT"))
    return _digest(back.withColumn("hash", F.col("signal_id")).withColumn("signal_id", F.col("path")), "sr", "ch", "n", "error")


def wav_probe(spark: SparkSession, d: str) -> DataFrame:
    return wav.probed(_files(spark, d, "PCM_24")).select(
        F.col("path").cast("bigint").alias("vec_id"),
        "sr",
        "ch",
        "n",
        "dur",
        "encoding",
    )


def _wide(described: DataFrame, **keys: str) -> DataFrame:
    """A row per signal, a column for each key."""
    return described.groupBy("signal_id").agg(
        *[F.max(F.when(F.col("key") == k, F.col("value"))).alias(n) for n, k in keys.items()]
    )


def kernel_levels(spark: SparkSession, d: str) -> DataFrame:
    rows = _wide(M.describe(_signals(spark, d), ("summary",)), peak="peak_dbfs", rms="rms_dbfs", dur="dur_s")
    return rows.select(F.col("signal_id").cast("bigint").alias("vec_id"), "peak", "rms", "dur")


def kernel_stereo(spark: SparkSession, d: str) -> DataFrame:
    rows = _wide(
        M.describe(_signals(spark, d, True), ("space", "qc")),
        penalty="space.mono_collapse_penalty_db",
        correlation="qc.phase.correlation",
        dc="qc.dc_offset_dbfs",
    )
    return rows.select(F.col("signal_id").cast("bigint").alias("vec_id"), "penalty", "correlation", "dc")


def kernel_gain(spark: SparkSession, d: str) -> DataFrame:
    return _digest(E.edited(_signals(spark, d), "gain", db=-6.0), "n", "error")


def kernel_reverse(spark: SparkSession, d: str) -> DataFrame:
    return _digest(E.edited(_signals(spark, d), "reverse"), "n", "error")


def kernel_crop(spark: SparkSession, d: str) -> DataFrame:
    return _digest(E.edited(_signals(spark, d), "crop", start=10 / RATE, end=30 / RATE), "n", "error")


def kernel_delay(spark: SparkSession, d: str) -> DataFrame:
    return _digest(E.edited(_signals(spark, d), "delay", ms=16 * 1000 / RATE, decay=0.5), "n", "error")


def kernel_fade(spark: SparkSession, d: str) -> DataFrame:
    return _digest(E.edited(_signals(spark, d), "env", kind="fade", attack=8 / RATE, release=16 / RATE), "n", "error")


def _demo(name: str) -> tuple[np.ndarray, int]:
    return wav.decode(wav.encode(R.demo_loop(), R.LOOP_RATE, "PCM_16"))


def demo_loop(spark: SparkSession, d: str) -> DataFrame:
    """The published values of the demo loop."""
    loop = R.table(spark, _demo, ["loop"])
    rows = _wide(
        M.describe(loop, ("loudness", "summary")),
        lufs="loudness.integrated_lufs",
        dbtp="loudness.true_peak_dbtp",
        short="loudness.max_short_term_lufs",
        seconds="dur_s",
    )
    onsets = I.slices(loop).groupBy("signal_id").agg(F.count("*").alias("onsets"))
    return rows.join(onsets, "signal_id")


_GOLDEN = ("silence", "dc", "sine", "ramp", "third", "stereo")


def _golden(encoding: str):
    return lambda name: wav.decode(wav.encode(R.golden(name), R.GOLDEN_RATE, encoding))


def golden_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Content ids of the conformance signals, through the encodings that they are published in."""
    out = None
    for encoding, names in (
        ("FLOAT", ["silence", "dc", "sine", "ramp", "stereo"]),
        ("PCM_16", ["ramp"]),
        ("PCM_24", ["ramp"]),
        ("DOUBLE", ["third"]),
    ):
        signals = R.table(spark, lambda name: (R.golden(name), R.GOLDEN_RATE), names)
        if encoding == "DOUBLE":
            signals = R.table(spark, _golden(encoding), names)
        files = wav.encoded(signals, "FLOAT" if encoding == "DOUBLE" else encoding).withColumnRenamed("signal_id", "path")
        part = wav.decoded(files).select(
            F.col("path").alias("name"),
            F.lit(encoding).alias("encoding"),
            F.col("signal_id").alias("hash"),
        )
        out = part if out is None else out.union(part)
    return out


_RATE = 44_100
_MADE = ("tone", "loud", "offset", "pair", "antiphase", "spiked", "gapped", "silent")


def _made(name: str) -> tuple[np.ndarray, int]:
    x = R.tone(1000, 2, 0.5, _RATE)
    if name == "spiked":
        x = 0.2 * x
        x[30_000] += 0.8
    if name == "gapped":
        x[20_000:22_000] = 0
    return {
        "loud": 2 * x,
        "offset": 0.2 * x + 0.1,
        "pair": np.repeat(x, 2, 1),
        "antiphase": np.repeat(x, 2, 1) * [1, -1],
        "silent": 0 * x,
    }.get(name, x), _RATE


def kernel_findings(spark: SparkSession, d: str) -> DataFrame:
    """What the quality checks find in signals with one fault each. Sound sets in again after the gap with a jump, which is a click."""
    made = R.table(spark, _made, list(_MADE))
    keys = {
        "clipped": "qc.clipping.detected",
        "dc": "qc.dc_offset_dbfs",
        "correlation": "qc.phase.correlation",
        "lossy": "qc.lossy.confidence",
        "penalty": "space.mono_collapse_penalty_db",
        "width": "width.full.correlation",
        "lufs": "loudness.integrated_lufs",
        "dbtp": "loudness.true_peak_dbtp",
    }
    rows = _wide(M.describe(made, ("qc", "space", "width", "loudness")), **keys)
    rows = rows.withColumn("dc", F.when(F.col("dc") > -60, F.round("dc", 1))).withColumns(
        {"lufs": F.round("lufs", 0), "dbtp": F.round("dbtp", 1)}
    )
    marks = M.markers(made).groupBy("signal_id").agg(
        F.count_if(F.col("label") == "click").alias("clicks"),
        F.count_if(F.col("label") == "gap").alias("gaps"),
        F.max(F.when(F.col("label") == "gap", F.col("sample"))).alias("gap_at"),
        F.max(F.when(F.col("label") == "gap", F.col("dur"))).alias("gap_s"),
    )
    return rows.join(marks, "signal_id", "left").na.fill(0, ["clicks", "gaps"])


#: name: (edit, how, what is measured of the result, decimals)
_EDITS = {
    "normalize": ("normalize", {"lufs": -20.0}, "loudness.integrated_lufs", 0),
    "limit": ("limit", {"ceiling": -9.0}, "loudness.true_peak_dbtp", 1),
    "maximize": ("maximize", {"ceiling": -3.0, "makeup": 12.0}, "peak_dbfs", 1),
    "gain": ("gain", {"db": -6.0}, "rms_dbfs", 1),
    "crop": ("crop", {"start": 0.5, "end": 0.75}, "dur_s", 4),
    "stretch": ("stretch", {"ratio": 1.5}, "dur_s", 2),
    "pitch": ("pitch", {"semitones": 3}, "dur_s", 2),
    "convert": ("convert", {"sr": 22_050}, "sr_hz", 0),
    "highpass": ("filter", {"hp": 100.0}, "rms_dbfs", 1),
    "reverb": ("reverb", {"amount": 50.0, "seconds": 0.5}, "dur_s", 2),
    "widen": ("widen", {}, "rms_dbfs", 1),
    "compress": ("compress", {"threshold": 0.0}, "rms_dbfs", 1),
    "wrong": ("stretch", {"ratio": -1.0}, "dur_s", 2),
}


def kernel_promises(spark: SparkSession, d: str) -> DataFrame:
    """edit, value, failed: what each edit promises of a tone of amplitude one half, two seconds long."""
    made, out = R.table(spark, _made, ["tone"]), None
    for name, (edit, how, key, places) in _EDITS.items():
        done = E.edited(made, edit, **how)
        rows = M.describe(
            done.where("error is null"),
            ("loudness", "summary"),
        ).where(F.col("key") == key).select("signal_id", "value")
        part = done.select("signal_id", F.col("error").isNotNull().alias("failed")).join(rows, "signal_id", "left").select(
            F.lit(name).alias("edit"),
            (F.round("value", places) + 0.0).alias("value"),
            "failed",
        )
        out = part if out is None else out.union(part)
    return out


def kernel_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Edits of two signals: a signal brought to its own spectrum stays, and a vocoder takes the shorter length."""
    made = R.table(spark, _made, ["tone", "loud"]).withColumn("pair", F.lit(1))
    tone = made.where("signal_id = 'tone'")
    out = None
    for name, other in (("spectral-match", tone), ("vocode", made.where("signal_id = 'loud'"))):
        done = E.paired(tone, other, name)
        rows = M.describe(done.where("error is null"), ("summary",)).where("key = 'rms_dbfs'").select("signal_id", "value")
        kept = F.when(F.lit(name == "spectral-match"), F.round("value", 1))
        part = done.join(rows, "signal_id", "left").select(
            "signal_id",
            "n",
            F.concat_ws("+", "lineage").alias("parents"),
            F.col("error").isNotNull().alias("failed"),
            kept.alias("level"),
        )
        out = part if out is None else out.union(part)
    return out


def frames_read(spark: SparkSession, d: str) -> DataFrame:
    """Files of every signal as frames; every seventh file is broken."""
    broken = F.col("path").cast("bigint") % 7 == 0
    files = _files(spark, d, "PCM_16").withColumn("content", F.when(~broken, F.col("content")).otherwise(F.lit(b"RIFF?")))
    f = T.read_stage(files)
    place = F.row_number().over(Window.partitionBy("kind").orderBy("pos"))
    meta = lambda k, kind: F.get_json_object("meta", f"$.{k}").cast(kind).alias(k)
    code, source = F.get_json_object("data", "$.code"), F.get_json_object("params", "$.source")
    return f.withColumn("place", place).select(
        "kind",
        "role",
        "op",
        "media",
        meta("sr", "int"),
        meta("ch", "int"),
        meta("dur", "double"),
        code.alias("code"),
        source.alias("source"),
        "place",
        F.size(FR.problems()).alias("problems"),
    )


def frames_bridged(spark: SparkSession, d: str) -> DataFrame:
    f = T.from_wav(_files(spark, d, "FLOAT"), derives_from="embeddings")
    told = lambda k: F.get_json_object("params", f"$.{k}")
    return f.groupBy("kind", "role", told("via").alias("via"), told("derives_from").alias("derives_from")).agg(
        F.count("*").alias("n"),
        F.count_if(told("input_hash") == F.col("hash")).alias("hashed"),
        F.count_if(F.col("lineage").isNotNull()).alias("with_lineage"),
    )


def frames_embedded(spark: SparkSession, d: str) -> DataFrame:
    signals = _signals(spark, d)
    f = T.embed_stage(signals)
    return f.groupBy("kind", F.get_json_object("meta", "$.dim").cast("int").alias("dim")).agg(
        F.count("*").alias("n"),
        F.count_if(F.size(FR.problems()) > 0).alias("problems"),
        F.count_distinct("of").alias("parents"),
    )


def kernel_octaves(spark: SparkSession, d: str) -> DataFrame:
    """A tone stands in its own sixth of an octave, and in its own band."""
    made = R.table(spark, lambda name: (R.tone(float(name), 2, 0.5, _RATE), _RATE), ["125", "1000", "8000"])
    rows = M.describe(made, ("octave-spectrum",)).withColumn("table", F.element_at(F.split("key", r"\."), 2))
    return rows.groupBy("signal_id", "table").agg(
        F.max_by("key", "value").alias("key"),
        (F.round(F.max("value"), 0) + 0.0).alias("level"),
    )


def kernel_movement(spark: SparkSession, d: str) -> DataFrame:
    """A steady tone neither moves nor decays; one that stops halfway through its tail does. Too short a signal tells nothing."""

    def made(name: str) -> tuple[np.ndarray, int]:
        x = R.tone(1000, 0.5 if name == "short" else 2, 0.5, _RATE)
        if name == "halved":
            x[-_RATE // 10 :] *= 0.1
        return x, _RATE

    rows = M.describe(R.table(spark, made, ["steady", "halved", "short"]), ("movement",))
    wide = _wide(rows, tail="movement.tail_decay_200ms_db", swing="movement.sidechain_db", quiet="movement.hf_silence_pct")
    return wide.select("signal_id", *[(F.round(c, 0) + 0.0).alias(c) for c in ("tail", "swing")])


_SIG = "sig AS (SELECT vec_id, embedding AS a FROM embeddings)"


def _sum(a: str) -> str:
    return f"round(list_sum(list_transform({a}, lambda x, i: x::DOUBLE * i)), 6)"


_DB = "round(20 * log10({0}), 2)"
SQL = {
    "wav_round_trip": f"WITH {_SIG} SELECT vec_id, {RATE} AS sr, 1 AS ch, 64 AS n, NULL::VARCHAR AS error, {_sum('a')} AS y FROM sig",
    "wav_probe": f"SELECT vec_id, {RATE} AS sr, 1 AS ch, 64::BIGINT AS n, 0.01::DOUBLE AS dur, 'PCM_24' AS encoding FROM embeddings",
    "kernel_levels": f"WITH {_SIG} SELECT vec_id, {_DB.format('list_max(list_transform(a, lambda x: abs(x::DOUBLE)))')} AS peak, {_DB.format('sqrt(list_sum(list_transform(a, lambda x: x::DOUBLE * x::DOUBLE)) / 64)')} AS rms, 0.01::DOUBLE AS dur FROM sig",
    "kernel_stereo": f"WITH {_SIG}, x AS (SELECT vec_id, unnest(a[1:32])::DOUBLE AS l, unnest(a[33:64])::DOUBLE AS r FROM sig) SELECT vec_id, round(greatest(0, least(60, 10 * log10((avg(l * l) + avg(r * r)) / 2 / avg((l + r) * (l + r) / 4)))), 3) AS penalty, round(corr(l, r), 4) AS correlation, {_DB.format('greatest(abs(avg(l)), abs(avg(r)))')} AS dc FROM x GROUP BY vec_id",
    "kernel_gain": f"WITH {_SIG} SELECT vec_id, 64 AS n, NULL::VARCHAR AS error, {_sum('list_transform(a, lambda x: (x::DOUBLE * pow(10, -6.0 / 20))::FLOAT)')} AS y FROM sig",
    "kernel_reverse": f"WITH {_SIG} SELECT vec_id, 64 AS n, NULL::VARCHAR AS error, {_sum('list_reverse(a)')} AS y FROM sig",
    "kernel_crop": f"WITH {_SIG} SELECT vec_id, 20 AS n, NULL::VARCHAR AS error, {_sum('a[11:30]')} AS y FROM sig",
    "kernel_delay": f"WITH {_SIG} SELECT vec_id, 80 AS n, NULL::VARCHAR AS error, {_sum('list_transform(range(1, 81), lambda k: greatest(-1, least(1, 0.9::DOUBLE * (0.8::DOUBLE * coalesce(a[k]::DOUBLE, 0) + CASE WHEN k > 16 THEN 0.5::DOUBLE * a[k - 16]::DOUBLE ELSE 0 END)))::FLOAT)')} AS y FROM sig",
    "kernel_fade": f"WITH {_SIG} SELECT vec_id, 64 AS n, NULL::VARCHAR AS error, {_sum('list_transform(a, lambda x, i: (x::DOUBLE * (least(1.0::DOUBLE, (i - 1) / 8.0::DOUBLE) * least(1.0::DOUBLE, (64 - i) / 16.0::DOUBLE)))::FLOAT)')} AS y FROM sig",
    "frames_read": f"WITH f AS (SELECT CASE WHEN vec_id % 7 = 0 THEN 'error' ELSE 'audio' END AS kind, vec_id::VARCHAR AS path FROM embeddings) SELECT kind, CASE kind WHEN 'audio' THEN 'source' END AS role, 'read' AS op, CASE kind WHEN 'audio' THEN 'audio/wav' END AS media, CASE kind WHEN 'audio' THEN {RATE} END AS sr, CASE kind WHEN 'audio' THEN 1 END AS ch, CASE kind WHEN 'audio' THEN 0.01::DOUBLE END AS dur, CASE kind WHEN 'error' THEN 'decode_failed' END AS code, CASE kind WHEN 'audio' THEN path END AS source, row_number() OVER (PARTITION BY kind ORDER BY path) AS place, 0 AS problems FROM f",
    "frames_bridged": "SELECT 'audio' AS kind, 'from-wav' AS role, 'raw-wav-bridge' AS via, 'embeddings' AS derives_from, count(*) AS n, count(*) AS hashed, 0::BIGINT AS with_lineage FROM embeddings",
    "frames_embedded": "SELECT 'vector' AS kind, 64 AS dim, count(*) AS n, 0::BIGINT AS problems, count(DISTINCT vec_id) AS parents FROM embeddings",
    "kernel_octaves": "SELECT signal_id, \"table\", key, 0.0::DOUBLE AS level FROM (VALUES ('125', 'oct6', 'spectrum.oct6.125'), ('125', 'band', 'spectrum.band.bass'), ('1000', 'oct6', 'spectrum.oct6.1000'), ('1000', 'band', 'spectrum.band.mid'), ('8000', 'oct6', 'spectrum.oct6.8000'), ('8000', 'band', 'spectrum.band.air')) o(signal_id, \"table\", key)",
    "kernel_movement": "SELECT signal_id, tail::DOUBLE AS tail, swing::DOUBLE AS swing FROM (VALUES ('steady', 0, 0), ('halved', 20, 0), ('short', NULL, NULL)) m(signal_id, tail, swing)",
    # Published values.
    "demo_loop": "SELECT 'loop' AS signal_id, -20.79::DOUBLE AS lufs, -6.71::DOUBLE AS dbtp, -20.71::DOUBLE AS short, 4.0::DOUBLE AS seconds, 18::BIGINT AS onsets",
    "golden_hashes": "SELECT name, encoding, 'blake3:' || digest AS hash FROM (VALUES ('silence', 'FLOAT', '85157125b381a2aa60b4db1a5f4336f6d722e4df25dc64f9028e81ff93a033ea'), ('dc', 'FLOAT', 'e4b450d61d3282fe2cff6918fee8fe12cc447ff02ab2fd93eb3607edad510a21'), ('sine', 'FLOAT', '2f5c977cafeed3521597ce198e6d5c5a592c0cee32f9e60d7197723c777fe39d'), ('ramp', 'FLOAT', '47a9498d3c25b344e4d8dcce9cc922accac94087e6913a7cf1529763b5af54aa'), ('ramp', 'PCM_16', 'e6cf482438becee1a7de96750fab88cf09a5e7087bed3994c8f40f7f77f6ac95'), ('ramp', 'PCM_24', 'a2e5fac038771448106c90db99da7d88cdf0d45c8ad5aaee286c08af2dad933b'), ('third', 'DOUBLE', 'c11eb728fe5b32849563055863e8e2d544757c61a39252a577b8559abc8bfb16'), ('stereo', 'FLOAT', '4e97447b519d2db88016d5408057bc344332c968c2183bd3cee703084d44a536')) g(name, encoding, digest)",
    # Values that follow from how the signals are made.
    "kernel_findings": "SELECT signal_id, clipped::DOUBLE AS clipped, dc::DOUBLE AS dc, correlation::DOUBLE AS correlation, 0.0::DOUBLE AS lossy, penalty::DOUBLE AS penalty, width::DOUBLE AS width, lufs::DOUBLE AS lufs, dbtp::DOUBLE AS dbtp, clicks::BIGINT AS clicks, gaps::BIGINT AS gaps, gap_at::BIGINT AS gap_at, gap_s::DOUBLE AS gap_s FROM (VALUES ('tone', 0, NULL, NULL, 0, 1, -9, -6.0, 0, 0, NULL, NULL), ('loud', 1, NULL, NULL, 0, 1, -3, 0.0, 0, 0, NULL, NULL), ('offset', 0, -20, NULL, 0, 1, -23, -14.0, 0, 0, NULL, NULL), ('pair', 0, NULL, 1, 0, 1, -6, -6.0, 0, 0, NULL, NULL), ('antiphase', 0, NULL, -1, 60, -1, -6, -6.0, 0, 0, NULL, NULL), ('spiked', 0, NULL, NULL, 0, 1, -23, -0.9, 1, 0, NULL, NULL), ('gapped', 0, NULL, NULL, 0, 1, -9, -6.0, 1, 1, 20000, 0.045351), ('silent', 0, NULL, NULL, 0, 1, NULL, NULL, 0, 0, NULL, NULL)) f(signal_id, clipped, dc, correlation, penalty, width, lufs, dbtp, clicks, gaps, gap_at, gap_s)",
    "kernel_pairs": "SELECT signal_id, 88200 AS n, parents, false AS failed, level::DOUBLE AS level FROM (VALUES ('spectral-match:tone', 'tone+tone', -9.0), ('vocode:tone', 'tone+loud', NULL)) p(signal_id, parents, level)",
    "kernel_promises": "SELECT edit, value::DOUBLE AS value, failed FROM (VALUES ('normalize', -20.0, false), ('limit', -9.0, false), ('maximize', -3.0, false), ('gain', -15.0, false), ('crop', 0.25, false), ('stretch', 3.0, false), ('pitch', 2.0, false), ('convert', 22050.0, false), ('highpass', -9.0, false), ('reverb', 2.5, false), ('widen', -9.0, false), ('compress', -9.0, false), ('wrong', NULL, true)) p(edit, value, failed)",
}
QUERIES = {name: globals()[name] for name in SQL}
