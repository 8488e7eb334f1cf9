"""Removal of repeated runs of lines, by a suffix array over line ids.

Documents are sequences of line ids. Prefix doubling ranks their suffixes: after
round k, suffixes carry the rank of their first 2**k lines, a name that keeps
the suffixes' order; the next round sorts the pairs of the ranks at a place and
2**k lines on. Suffixes that are alone take no further part.

The suffixes whose longest common prefix is n lines or more are an interval of
the suffix array, named by (n, the rank of the first 2**k lines, the rank of the
last 2**k of the n lines), where 2**k <= n < 2**(k + 1): two ranks of one round say
whether two runs of n lines are equal. A run of lines is a later copy unless it is
the first of its interval, by doc_id and place.

Every run of LEAST_WORDS words or more that is a later copy is deleted. Of a
document's runs only the tight ones need to be looked up: from each line the
shortest run that begins there and has so many words, and the shortest that ends
there. Parts of a later copy are later copies themselves, so the tight ones among
them cover each line of every maximal run (longest common prefix with an earlier
suffix): a line stands either far enough from the end for the tight run that begins
with it to lie inside, or the one that ends with it does. A line thus asks for two
runs, however long the repeats are, and rounds end at the longest tight run.

Cases: null text has no lines and stays null; rows that repeat id and text are
one document and are cut alike. Copies of one text under several ids, null
first, keep the lines of the first. Blank lines are lines, without words. Two runs
copied from different places count their words apart, even where they overlap. A
text that loses all its lines becomes empty; keep_documents drops it. An empty
table gives no rows. All other columns stay, whatever their names; texts may have
any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonorel.llm.common import broadcast_if_small, column, drop_table, materialize

LEAST_WORDS = 50


def _named(docs: DataFrame) -> DataFrame:
    """row (all columns), _id, _hash: what names a document."""
    row = F.struct(*map(column, docs.columns)).alias("row")
    return docs.select(row).select("row", F.col("row.doc_id").alias("_id"), F.xxhash64("row.text").alias("_hash"))


def lines(docs: DataFrame) -> DataFrame:
    """_id, _hash, i, line (its id), words. The outer explosion spares a test, text by text, whether there are lines."""
    each = F.posexplode_outer(F.split(F.col("row.text"), "\n")).alias("i", "_line")
    found = _named(docs).where(F.col("row.text").isNotNull()).select("_id", "_hash", each)
    words = F.size(F.array_remove(F.split("_line", r"[\x20\x09-\x0D]+"), ""))
    return found.select("_id", "_hash", "i", F.xxhash64("_line").alias("line"), words.alias("words"))


def _ranked(classes: DataFrame, keys: list[str]) -> DataFrame:
    """Adds rank: larger for larger keys. Ranges of keys are sorted apart, and the rows' numbers follow the ranges."""
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = classes.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return materialize(ordered.withColumn("rank", F.monotonically_increasing_id()), "ranks")


def stretches(found: DataFrame, least_words: int) -> DataFrame:
    """doc, seg, i, line, words, upto (words of the stretch up to the line's end): of stretches of neighbouring lines
    that all occur twice and have enough words together. found: doc, i, line, words."""
    apart = found.withColumn("seg", F.col("i") - F.row_number().over(Window.partitionBy("doc").orderBy("i")))
    own = Window.partitionBy("doc", "seg")
    upto = F.sum("words").over(own.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return apart.withColumns({"upto": upto, "all": F.sum("words").over(own)}).where(F.col("all") >= least_words).drop("all")


def tight_runs(found: DataFrame, least_words: int) -> DataFrame:
    """doc, a, n: for each line, the shortest run of enough words that begins there, and the shortest that ends there.

    Along a stretch, ends of lines stand at the words up to them, and beginnings at the words before. A beginning asks
    for the first end at least so many words on, and an end for the last beginning so many words back; questions and
    answers are sorted together, so a stretch costs what sorting it does."""
    before = F.col("upto") - F.col("words")
    mark = lambda kind, at: F.struct(F.lit(kind).alias("kind"), at.cast("long").alias("at"))
    begin, end, want_end, want_begin = 0, 1, 2, 3
    marks = F.array(
        mark(begin, before),
        mark(end, F.col("upto")),
        mark(want_end, before + least_words),
        mark(want_begin, F.col("upto") - least_words),
    )
    each = found.select("doc", "seg", "i", F.explode(marks).alias("m")).select("doc", "seg", "i", "m.kind", "m.at")
    own = Window.partitionBy("doc", "seg")
    down = own.orderBy(F.desc("at"), F.col("kind") != end, F.desc("i"))
    up = own.orderBy("at", F.col("kind") != begin, "i")
    last = lambda kind, over: F.last(
        F.when(F.col("kind") == kind, F.col("i")),
        ignorenulls=True,
    ).over(over.rowsBetween(Window.unboundedPreceding, 0))
    answered = each.withColumns({"to": last(end, down), "from": last(begin, up)})
    a = F.when(F.col("kind") == want_end, F.col("i")).when(F.col("kind") == want_begin, F.col("from"))
    b = F.when(F.col("kind") == want_end, F.col("to")).when(F.col("kind") == want_begin, F.col("i"))
    return answered.select("doc", a.alias("a"), (b - a + 1).alias("n")).where("n is not null").distinct()


def later_runs(found: DataFrame, least_words: int) -> DataFrame:
    """doc, a, n: the tight runs that are later copies. found: doc, i, line, words, of lines that occur at least twice."""
    spark = found.sparkSession
    found = materialize(stretches(found, least_words), "stretches")
    runs = materialize(tight_runs(found, least_words), "runs")
    longest = runs.agg(F.max("n")).first()[0] or 0
    classes = _ranked(found.groupBy("line").agg(F.count("*").alias("m")).where("m > 1").select("line"), ["line"])
    now = materialize(found.join(classes, "line").select("doc", "i", "rank"), "suffixes")
    named, size = [], 1
    while size <= longest:
        first = now.select("doc", F.col("i").alias("a"), F.col("rank").alias("head"))
        last = now.select("doc", F.col("i").alias("z"), F.col("rank").alias("tail"))
        own = runs.where(
            (F.col("n") >= size) & (F.col("n") < 2 * size)
        ).join(first, ["doc", "a"]).withColumn("z", F.col("a") + F.col("n") - size)
        named.append(materialize(own.join(last, ["doc", "z"]).select("doc", "a", "n", "head", "tail"), "intervals"))
        if 2 * size > longest:
            break
        after = now.select("doc", (F.col("i") - size).alias("i"), F.col("rank").alias("next"))
        pairs = materialize(
            now.select("doc", "i", "rank").join(after, ["doc", "i"]).withColumnRenamed("rank", "r").withColumnRenamed("next", "s"),
            "pairs",
        )
        classes = _ranked(pairs.groupBy("r", "s").agg(F.count("*").alias("m")).where("m > 1").select("r", "s"), ["r", "s"])
        now = materialize(pairs.join(classes, ["r", "s"]).select("doc", "i", "rank"), "suffixes")
        drop_table(spark, pairs)
        size *= 2
    if not named:
        return runs
    every = named[0]
    for more in named[1:]:
        every = every.union(more)
    interval = ["n", "head", "tail"]
    here = F.struct("doc", "a")
    firsts = every.groupBy(*interval).agg(F.count("*").alias("m"), F.min(here).alias("first")).where("m > 1").drop("m")
    firsts = broadcast_if_small(materialize(firsts, "firsts"))
    return every.join(firsts, interval).where(here != F.col("first")).select("doc", "a", "n")


def later_copies(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """_id, _hash, gone: the first and last numbers of the stretches of lines to delete, of documents that have some."""
    every = lines(docs)
    twice = materialize(every.groupBy("line").agg(F.count("*").alias("n")).where("n > 1").select("line"), "repeated-lines")
    some = every.join(broadcast_if_small(twice), "line", "left_semi")
    some = materialize(some.distinct(), "lines")
    # Documents are numbered in the order of their ids, so that the first copy is the smallest.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = some.select("_id", "_hash").distinct().repartitionByRange(n, "_id", "_hash").sortWithinPartitions("_id", "_hash")
    names = materialize(names.withColumn("doc", F.monotonically_increasing_id()), "documents")
    named = some.join(
        names,
        some["_id"].eqNullSafe(names["_id"]) & (some["_hash"] == names["_hash"]),
    ).select("doc", "i", "line", "words")
    runs = later_runs(materialize(named, "numbered"), least_words).select("doc", "a", (F.col("a") + F.col("n") - 1).alias("b"))
    order = Window.partitionBy("doc").orderBy("a", "b")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("a") > F.col("before"), F.lit(True))
    marked = runs.withColumn("before", before).withColumn("part", F.sum(fresh.cast("int")).over(order))
    whole = marked.groupBy("doc", "part").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    gone = whole.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("gone"))
    return materialize(gone.join(names, "doc").select("_id", "_hash", "gone"), "gone")


def _left(text: Column, gone: Column) -> Column:
    """The lines of the text between the stretches that go. The split text is bound to a variable, so it is split once."""

    def cut(x: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(x["gone"], lambda s: s["b"] + 1))
        ends = F.concat(F.transform(x["gone"], lambda s: s["a"]), F.array(F.size(x["parts"])))
        return F.array_join(F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(x["parts"], s + 1, e - s))), "\n")

    return F.transform(F.array(F.struct(F.split(text, "\n").alias("parts"), gone.alias("gone"))), cut)[0]


def removed(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """row, text (what is left), gone."""
    gone = later_copies(docs, least_words).select(F.col("_id").alias("_i"), F.col("_hash").alias("_h"), "gone")
    found = _named(docs).join(
        broadcast_if_small(gone),
        F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")),
        "left",
    )
    text = F.when(F.col("gone").isNotNull(), _left(F.col("row.text"), F.col("gone"))).otherwise(F.col("row.text"))
    return found.select("row", text.alias("text"), "gone")


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, removed_lines (numbers from 0, comma-joined), text (what is left)."""
    numbers = F.flatten(F.transform("gone", lambda s: F.sequence(s["a"], s["b"])))
    return removed(docs, least_words).select(
        F.col("row.doc_id").alias("doc_id"),
        F.coalesce(F.size(F.split(F.col("row.text"), "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(
            F.aggregate("gone", F.lit(0), lambda n, s: n + (s["b"] - s["a"] + 1)),
            F.lit(0),
        ).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(numbers, ","), F.lit("")).alias("removed_lines"),
        "text",
    )


def keep_documents(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """All columns, with text cut; documents whose lines are all later copies go."""
    found = removed(docs, least_words).where(F.col("gone").isNull() | (F.col("text") != ""))
    return found.select(*[F.col("text") if c == "text" else column(c, "row") for c in docs.columns])
