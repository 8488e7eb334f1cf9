"""Quality rules whose thresholds adapt to language and source.

Each document is measured by built-in functions: words, symbols, repeated lines
and repeated stretches. Every measure goes, as a whole number, into a quantile
sketch per language and source: a histogram whose buckets keep the leading bits
of the value, so sketches have bounded size and bounded relative error, merge by
adding counts, and don't depend on the order of rows. A measure's fence is its
upper quartile plus a multiple of the spread between quartiles. Small groups
take the fences of their language, whose sketch is the merged one of its
sources, or of the whole corpus. Joining the fences back filters the documents.

Cases: null text counts as empty, with all measures 0; null language or source
counts as an empty string. Documents of fewer than LEAST_WORDS words fail.
Texts may have any length. Repeated rows count each and get equal verdicts. An
empty table gives no rows. filter_documents keeps all columns, whatever their
names, and measures only text, lang and source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonorel.llm.common import broadcast_if_small, column, materialize

SPACE = r"[\x20\x09-\x0D]+"
LEAST_WORDS = 20
WINDOW = 8
#: Groups of fewer documents take the fences of their language, or of all documents.
LEAST_GROUP = 50
#: Fence: upper quartile + REACH * max(quartile spread, noise). Measures, in thousandths, with the spread that counts as noise.
REACH = 3
MEASURES = {"m_word_length": 2000, "m_symbols": 25, "m_dup_lines": 150, "m_repeats": 100, "m_capitals": 80}
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _share(part: Column, whole: Column) -> Column:
    """part / whole in thousandths, rounded down; 0 if whole is 0."""
    return F.when(whole > 0, F.floor(part * 1000 / whole)).otherwise(0).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """row (a struct of all columns), lang, source, the counts, base_failed and the measures."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    df = docs.select(F.struct(*map(column, docs.columns)).alias("row"))
    df = df.select(
        "row",
        F.coalesce(F.col("row.lang"), F.lit("")).alias("lang"),
        F.coalesce(F.col("row.source"), F.lit("")).alias("source"),
        text.alias("text"),
        F.array_remove(F.split(text, SPACE), "").alias("words"),
    )
    n = F.size("words")
    grams = F.when(
        n > WINDOW,
        F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW))),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        "row",
        "lang",
        "source",
        "text",
        n.alias("n"),
        F.length(F.array_join("words", "")).alias("chars"),
        grams.alias("grams"),
        lines.alias("lines"),
    )
    # Most texts repeat no window; only the others are sorted to find which.
    repeats = F.size(F.array_distinct("grams")) < F.size("grams")
    df = df.select(
        "row",
        "lang",
        "source",
        "text",
        "n",
        "chars",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("dups"),
        F.when(repeats, F.array_sort(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s"),
    )
    h = lambda j: F.get(F.col("s"), j)["h"]
    twice = F.filter(
        "s",
        lambda x, j: F.coalesce(h(j - 1) == x["h"], F.lit(False)) | F.coalesce(h(j + 1) == x["h"], F.lit(False)),
    )
    places = F.array_sort(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum")),
        lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(WINDOW), p - a["last"])).alias("sum")),
        lambda a: a["sum"],
    )
    long = lambda c: c.cast("long")
    df = df.select(
        "row",
        "lang",
        "source",
        long(F.col("n")).alias("n_words"),
        long(F.col("chars")).alias("word_chars"),
        long(F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).alias("n_symbols"),
        long(F.col("dups")).alias("n_dup_lines"),
        long(F.coalesce(F.when(F.col("s").isNotNull(), covered), F.lit(0))).alias("n_repeat_words"),
        long(F.col("n_lines")).alias("n_lines"),
        long(F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))).alias("n_capitals"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    shares = {
        "m_word_length": _share(F.col("word_chars"), F.col("n_words")),
        "m_symbols": _share(F.col("n_symbols"), F.col("word_chars")),
        "m_dup_lines": _share(F.col("n_dup_lines"), F.col("n_lines")),
        "m_repeats": _share(F.col("n_repeat_words"), F.col("n_words")),
        "m_capitals": _share(F.col("n_capitals"), F.col("word_chars")),
    }
    return df.withColumns({"base_failed": failed, **shares})


def bucket(v: Column, bits: int = 7) -> Column:
    """The value with all but its leading bits cleared."""
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.length(F.bin(v)) - bits)).cast("long")
    return v - F.pmod(v, step)


def sketch(features: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n."""
    stack = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in MEASURES])).alias("x")
    flat = features.where("n_words > 0").select("lang", "source", stack).select(
        "lang",
        "source",
        "x.measure",
        bucket(F.col("x.value")).alias("bucket"),
    )
    return flat.groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, *by: str) -> DataFrame:
    return sketches.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, *by: str) -> DataFrame:
    """by..., size, and for each measure the largest value that passes."""
    whole = Window.partitionBy(*by, "measure")
    to_here = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    c = sketches.withColumns({"below": F.sum("n").over(to_here), "size": F.sum("n").over(whole)})
    low = F.min(F.when(4 * F.col("below") >= F.col("size"), F.col("bucket")))
    high = F.min(F.when(4 * F.col("below") >= 3 * F.col("size"), F.col("bucket")))
    q = c.groupBy(*by, "measure").agg(F.max("size").alias("size"), low.alias("q25"), high.alias("q75"))
    noise = F.coalesce(*[F.when(F.col("measure") == m, F.lit(v)) for m, v in MEASURES.items()])
    q = q.withColumn("fence", F.col("q75") + REACH * F.greatest(F.col("q75") - F.col("q25"), noise))
    return q.groupBy(*by).agg(
        F.max("size").alias("size"),
        *[F.max(F.when(F.col("measure") == m, F.col("fence"))).alias(f"f_{m}") for m in MEASURES],
    )


def group_fences(features: DataFrame) -> DataFrame:
    """lang, source and the fences that hold for them."""
    own = materialize(sketch(features), "sketch")
    named = lambda df, p: df.select(
        *[c for c in df.columns if c in ("lang", "source")],
        F.col("size").alias(f"{p}size"),
        *[F.col(f"f_{m}").alias(f"{p}{m}") for m in MEASURES],
    )
    by_source = named(fences(own, "lang", "source"), "a")
    by_lang = named(fences(merge(own, "lang"), "lang"), "b")
    everything = named(fences(merge(own)), "c")
    joined = by_source.join(F.broadcast(everything)).join(by_lang, "lang")
    pick = lambda m: F.when(
        F.col("asize") >= LEAST_GROUP,
        F.col(f"a{m}"),
    ).when(F.col("bsize") >= LEAST_GROUP, F.col(f"b{m}")).otherwise(F.col(f"c{m}")).alias(f"f_{m}")
    return materialize(joined.select("lang", "source", *map(pick, MEASURES)), "fences")


def judged(features: DataFrame) -> DataFrame:
    """Adds kept. features must be a materialized table: it is read twice."""
    limits = broadcast_if_small(group_fences(features))
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & (F.col(m) <= F.col(f"f_{m}"))
    return features.join(limits, ["lang", "source"], "left").withColumn(
        "kept",
        ~F.col("base_failed") & F.coalesce(inside, F.lit(False)),
    )


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and the measures."""
    narrow = measured(docs.select("doc_id", "text", "lang", "source")).select(
        F.col("row.doc_id").alias("doc_id"),
        "lang",
        "source",
        *_COUNTS,
        "base_failed",
        *MEASURES,
    )
    return judged(materialize(narrow, "measures")).select("doc_id", *_COUNTS, "base_failed", "kept", *MEASURES)


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns."""
    wide = materialize(measured(docs).select("row", "lang", "source", "n_words", "base_failed", *MEASURES), "measured")
    return judged(wide).where("kept").select("row.*")


def _sql() -> str:
    shares = {
        "m_word_length": ("word_chars", "n_words"),
        "m_symbols": ("n_symbols", "word_chars"),
        "m_dup_lines": ("n_dup_lines", "n_lines"),
        "m_repeats": ("n_repeat_words", "n_words"),
        "m_capitals": ("n_capitals", "word_chars"),
    }
    share = ", ".join(f"CASE WHEN {w} > 0 THEN ({p} * 1000) // {w} ELSE 0 END AS {m}" for m, (p, w) in shares.items())
    stacked = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS v FROM m WHERE n_words > 0" for m in MEASURES)
    noise = "CASE measure " + " ".join(f"WHEN '{m}' THEN {v}" for m, v in MEASURES.items()) + " END"

    def level(name: str, by: str) -> str:
        keys = f"{by}, " if by else ""
        cum = f"SELECT {keys}measure, b, n, sum(n) OVER (PARTITION BY {keys}measure ORDER BY b) AS below, sum(n) OVER (PARTITION BY {keys}measure) AS size FROM (SELECT {keys}measure, b, count(*) AS n FROM buckets GROUP BY {keys}measure, b)"
        q = f"SELECT {keys}measure, max(size) AS size, min(b) FILTER (WHERE 4 * below >= size) AS q25, min(b) FILTER (WHERE 4 * below >= 3 * size) AS q75 FROM ({cum}) GROUP BY {keys}measure"
        f = f"SELECT {keys}measure, size, q75 + {REACH} * greatest(q75 - q25, {noise}) AS fence FROM ({q})"
        return f"{name} AS ({f})"

    tests = " AND ".join(
        f"{m} <= (SELECT CASE WHEN a.size >= {LEAST_GROUP} THEN a.fence WHEN b.size >= {LEAST_GROUP} THEN b.fence ELSE c.fence END FROM a JOIN b USING (lang, measure) JOIN c USING (measure) WHERE a.lang = m.lang AND a.source = m.source AND measure = '{m}')" for m in MEASURES
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
g AS (SELECT r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) > {WINDOW})),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range({WINDOW}) t(k) GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
counted AS (SELECT d.r, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
  coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines, (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_capitals
  FROM d JOIN w USING (r) LEFT JOIN covered USING (r) LEFT JOIN l USING (r)),
m AS (SELECT *, {share}, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted),
buckets AS (SELECT lang, source, measure, v - v % (1::BIGINT << greatest(0, length(bin(v)) - 7)) AS b FROM ({stacked})),
{level("a", "lang, source")}, {level("b", "lang")}, {level("c", "")}
SELECT doc_id, {", ".join(_COUNTS)}, base_failed, NOT base_failed AND coalesce({tests}, false) AS kept, {", ".join(MEASURES)} FROM m
"""


ORACLE_SQL = _sql()
