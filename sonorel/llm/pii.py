"""Personal data: base patterns, and information-theoretic sanitisation of terms that reveal it.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers.
What they name are the protected entities: each value, and what stands behind
several values (an address's host, an IP's network, a card's issuer, a phone's
area). Words near an entity are its contexts; counts over the whole corpus say how
strongly a word reveals it: with P(c) the share of the corpus's words that stand
near entity c, and P(c|t) the share of t's occurrences that do,
PMI(c; t) = log2(P(c|t) / P(c)) bits of the entity's information content
-log2 P(c) are disclosed. For P(c|t) stands the lower end of its confidence
interval (Wilson's, one-sided, 90 %), so a term seen a few times must tell more
than one seen often; no number of documents is asked for. Occurrences count as
independent.

A term that discloses REMOVE of an entity is removed. One that discloses GENERALISE
is replaced by its most specific class that discloses less: the words that share its
first four letters, those that share its first two, or any word, which tells
nothing. Both happen wherever the term stands: it tells of its entity also in a
document that names no entity, or another one. disclosures() says which entity a
term reveals, and how far.

Only built-in functions are used. The patterns are written so that Java's
matcher needs neither recursion nor repeated scans on long runs: separators that
can't belong to a match are first replaced, one character by another. Places are
added up in chunks of CHUNK matches, and texts are cut into a piece for each chunk,
so a text with very many spans costs little more than its length.

Cases: null text is empty. Matches that fail their test (parts over 255, wrong
number of digits, wrong check digit) are dropped, without another try. Repeated
rows count each and get equal spans. An empty table gives no rows. Texts may
have any length. sanitise keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonorel.llm.common import broadcast_if_small, column, materialize

KINDS = ["email", "ip", "card", "phone", "general", "remove"]
LABELS = ["<EMAIL>", "<IP>", "<CARD>", "<PHONE>", "<WORD>", ""]
CONTEXT_WORDS = 6
CONTEXT_CHARS = 160
#: Standard deviations of the one-sided 90 % bound on P(c|t).
BOUND = 1.2816
GENERALISE, REMOVE = 0.9, 0.97
#: Letters that the classes of a word share, the most specific class first.
CLASSES = (4, 2)
#: Matches whose places are added up together.
CHUNK = 128

_LOCAL, _DOMAIN = "A-Za-z0-9._%+-", "A-Za-z0-9-"
_EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@(?=[{_DOMAIN}]++\.)[{_DOMAIN}.]++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_CARD = r"[0-9][0-9\x20-]*[0-9]"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_WORD = r"[\p{L}\p{M}']+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a variable that holds the value: functions of arrays would work an expression out anew for each element."""
    return F.transform(F.array(value), body)[0]


def in_chunks(items: Column) -> Column:
    """The array (a variable) as an array of arrays of CHUNK elements; an empty one gives one empty chunk."""
    last = F.greatest(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * CHUNK + 1, F.lit(CHUNK)))


def folded(items: Column, at: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """array<kind>: what step adds to `out` of struct<at, out> along the items (a variable). Chunks are folded alone and
    put together at the end, as each addition copies the array so far."""
    none, nested = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def more(a: Column, chunk: Column) -> Column:
        own = F.aggregate(chunk, F.struct(a["at"].alias("at"), none.alias("out")), step)
        return let(own, lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], F.array(r["out"])).alias("out")))

    return F.aggregate(in_chunks(items), F.struct(at.alias("at"), nested.alias("out")), more, lambda a: F.flatten(a["out"]))


def occurrences(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of a pattern's matches, leftmost and non-overlapping: the pieces between matches give their places."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(
        gaps,
        hits,
        lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("size"), hit.alias("hit")),
    )

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        end = start + x["size"]
        span = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

    found = F.filter(both, lambda x: x["hit"].isNotNull())
    return let(found, lambda xs: folded(xs, F.lit(0), "struct<start:int,end:int,hit:string>", step))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]+", "")


def _is_card(x: Column) -> Column:
    return F.coalesce(F.when(F.length(x).between(14, 19), F.call_function("luhn_check", x)), F.lit(False))


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end, hit>>, kind: its number in KINDS; by start, then kind."""
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    dots = F.regexp_replace(text, rf"(?<![{_DOMAIN}])\.|\.(?![{_DOMAIN}])", "_")
    marks = F.regexp_replace(text, r"(?<![0-9])[\x20-]|[\x20-](?![0-9])", "\n")
    found = [
        F.when(F.contains(text, F.lit("@")), occurrences(dots, _EMAIL)),
        F.when(
            text.rlike(r"[0-9]\.[0-9]"),
            F.filter(occurrences(text, _IP), lambda x: x["hit"].rlike(rf"^(?:{_PART}\.){{3}}{_PART}$")),
        ),
        F.when(text.rlike("[0-9]"), F.filter(occurrences(marks, _CARD), lambda x: _is_card(_digits(x["hit"])))),
        F.when(
            text.rlike(r"\+[0-9]"),
            F.filter(occurrences(text, _PHONE), lambda x: F.length(_digits(x["hit"])).between(10, 15)),
        ),
    ]

    def named(k: int) -> Column:
        return F.transform(
            F.coalesce(found[k], none),
            lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), s["hit"].alias("hit")),
        )

    return F.array_sort(F.concat(*map(named, range(len(found)))))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def found_in(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """rid, the kept columns, _text, base (spans): a written table, so that rid is fixed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(*keep, text.alias("_text")).withColumn("base", base_spans(F.col("_text")))
    return materialize(base.withColumn("rid", F.monotonically_increasing_id()), "base-spans")


def entities(kind: Column, hit: Column) -> Column:
    """What a span names: the value, and what stands behind several values."""
    digits = _digits(hit)
    parts = F.split(F.lower(hit), "@")
    values = [
        (0, F.lower(hit), F.get(parts, F.size(parts) - 1)),
        (1, hit, F.regexp_extract(hit, r"^(.*)\.[0-9]+$", 1)),
        (2, digits, F.substring(digits, 1, 6)),
        (3, digits, F.substr(digits, F.lit(1), F.length(digits) - 4)),
    ]
    own = F.coalesce(
        *[F.when(kind == k, F.array(F.concat_ws(":", F.lit(KINDS[k]), value), F.concat_ws(":", F.lit(f"{KINDS[k]}-group"), group))) for k, value, group in values]
    )
    return own


def contexts(found: DataFrame) -> DataFrame:
    """entities, near (the words near the span, lower case), of each span. A piece of the text for each chunk of spans
    goes along with them, as cutting a text costs its length."""
    some = found.where(F.size("base") > 0).select("_text", F.explode_outer(let(F.col("base"), in_chunks)).alias("spans"))
    low = F.greatest(F.lit(0), F.get("spans", F.lit(0))["start"] - CONTEXT_CHARS)
    high = F.least(F.length("_text"), F.array_max(F.transform("spans", lambda s: s["end"])) + CONTEXT_CHARS)
    piece = F.substr("_text", low + 1, high - low)
    cut = some.select("spans", low.alias("from"), piece.alias("piece"), (high < F.length("_text")).alias("goes_on"))
    each = cut.select("from", "piece", "goes_on", F.explode("spans").alias("s"))
    start, end, size = F.col("s.start") - F.col("from"), F.col("s.end") - F.col("from"), F.length("piece")
    low = F.greatest(F.lit(0), start - CONTEXT_CHARS)
    high = F.least(size, end + CONTEXT_CHARS)
    before, after = F.substr("piece", low + 1, start - low), F.substr("piece", end + 1, high - end)
    # A word that the cut may have split isn't counted.
    before = F.when((low > 0) | (F.col("from") > 0), F.regexp_replace(before, r"^[\p{L}\p{M}']+", "")).otherwise(before)
    after = F.when((high < size) | F.col("goes_on"), F.regexp_replace(after, r"[\p{L}\p{M}']+$", "")).otherwise(after)
    near = each.select(
        entities(F.col("s.kind"), F.col("s.hit")).alias("entities"),
        words_of(F.lower(before)).alias("b"),
        words_of(F.lower(after)).alias("a"),
    )
    last = F.slice("b", F.greatest(F.lit(1), F.size("b") - CONTEXT_WORDS + 1), F.lit(CONTEXT_WORDS))
    return near.select("entities", F.concat(last, F.slice("a", 1, CONTEXT_WORDS)).alias("near"))


def least_share(hits: Column, of: Column) -> Column:
    """The lower end of Wilson's interval for hits / of."""
    share, square = hits / of, BOUND**2
    spread = BOUND * F.sqrt(share * (1 - share) / of + square / (4 * of * of))
    return (share + square / (2 * of) - spread) / (1 + square / of)


def disclosed(pairs: DataFrame) -> DataFrame:
    """Adds share: how much of the entity's information content the term or class discloses. pairs: n_joint, n_term, n_entity, n_words."""
    information = -F.log2(F.col("n_entity") / F.col("n_words"))
    # Windows of neighbouring spans overlap, so a word can be near an entity more often than it occurs.
    share = (F.log2(least_share(F.least("n_joint", "n_term"), F.col("n_term"))) + information) / information
    return pairs.where("n_entity < n_words").withColumn("share", share)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def vocabulary(found: DataFrame) -> DataFrame:
    """term, n_term: how often each word occurs in all documents; texts are cut into words once.

    Outer explosions, here and below, as Spark would ask of others twice before whether there are words at all."""
    each = found.select(F.explode_outer(words_of(F.lower("_text"))).alias("term")).where("term is not null")
    return materialize(each.groupBy("term").agg(F.count("*").alias("n_term")), "vocabulary")


def class_of(word: Column, letters: int) -> Column:
    """A longer word's class; other words are in none."""
    return F.when(F.length(word) > letters, F.concat(F.substring(word, 1, letters), F.lit("*")))


def disclosures(found: DataFrame) -> DataFrame:
    """term, kind, label (what stands for it), entity (the one that it reveals most), share: the terms that disclose an entity beyond the thresholds."""
    near = materialize(contexts(found), "contexts")
    each = near.select(F.explode("entities").alias("entity"), "near")
    size = each.groupBy("entity").agg(F.sum(F.size("near")).alias("n_entity"))
    joint = each.select("entity", F.explode("near").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_joint"))
    pairs = materialize(joint.join(broadcast_if_small(materialize(size, "entities")), "entity"), "pairs")
    wanted = materialize(pairs.select("term").distinct(), "terms")
    counts = vocabulary(found)
    pairs = pairs.withColumn("n_words", F.lit(counts.agg(F.sum("n_term")).first()[0] or 0))
    own = materialize(counts.join(broadcast_if_small(wanted), "term", "left_semi"), "counts")
    told = disclosed(pairs.join(broadcast_if_small(own), "term"))
    told = materialize(told.where(F.col("share") >= GENERALISE).select("term", "entity", "share"), "told")
    terms = told.groupBy("term").agg(
        F.max("share").alias("share"),
        F.max_by("entity", F.struct("share", "entity")).alias("entity"),
    )
    terms = terms.withColumn("kind", F.when(F.col("share") >= REMOVE, KINDS.index("remove")).otherwise(KINDS.index("general")))
    # The classes of the terms, and whether they too disclose an entity that the term does.
    label = F.lit(LABELS[KINDS.index("general")])
    for letters in reversed(CLASSES):
        mine = told.withColumn("class", class_of(F.col("term"), letters)).where("class is not null")
        asked = materialize(mine.select(F.col("class").alias("term")).distinct(), "classes")
        sums = counts.withColumn("term", class_of(F.col("term"), letters)).join(broadcast_if_small(asked), "term", "left_semi")
        sums = sums.groupBy("term").agg(F.sum("n_term").alias("n_term"))
        held = pairs.withColumn("term", class_of(F.col("term"), letters)).groupBy("entity", "term").agg(
            F.sum("n_joint").alias("n_joint"),
            F.first("n_entity").alias("n_entity"),
            F.first("n_words").alias("n_words"),
        )
        shares = disclosed(held.join(broadcast_if_small(materialize(sums, "class-counts")), "term")).select(
            "entity",
            F.col("term").alias("class"),
            F.col("share").alias("class_share"),
        )
        safe = mine.join(shares, ["entity", "class"]).groupBy("term").agg(
            F.max("class_share").alias("worst"),
            F.first("class").alias(f"class{letters}"),
        )
        terms = terms.join(safe.where(F.col("worst") < GENERALISE).drop("worst"), "term", "left")
        label = F.coalesce(F.col(f"class{letters}"), label)
    label = F.when(F.col("kind") == KINDS.index("remove"), LABELS[KINDS.index("remove")]).otherwise(label)
    return terms.select("term", "kind", label.alias("label"), "entity", "share")


def placed_words(rows: DataFrame) -> DataFrame:
    """rid, term, start, end of every word of _text: lengths of words and of the gaps between them are added up along the text, as rows, so a long text costs no more than its length."""
    text = F.col("_text")
    both = F.arrays_zip(F.split(text, _WORD, -1).alias("gap"), words_of(text).alias("hit"))
    each = rows.select("rid", F.posexplode_outer(both).alias("k", "w")).where("w.hit is not null").select(
        "rid",
        "k",
        F.length("w.gap").alias("gap"),
        F.col("w.hit").alias("hit"),
    )
    end = F.sum(F.col("gap") + F.length("hit")).over(Window.partitionBy("rid").orderBy("k"))
    return each.withColumn("end", end.cast("int")).select(
        "rid",
        F.lower("hit").alias("term"),
        (F.col("end") - F.length("hit")).alias("start"),
        "end",
    )


def apart(hits: DataFrame, base: DataFrame) -> DataFrame:
    """The hits that no base span of their row overlaps. Both: rid, start, end; sorted together, the ends before and the starts after are running extremes."""
    every = hits.withColumn("hit", F.lit(True)).unionByName(base.withColumn("hit", F.lit(False)), allowMissingColumns=True)
    forth = Window.partitionBy("rid").orderBy("start", "hit").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("rid").orderBy(F.desc("start"), F.desc("hit")).rowsBetween(Window.unboundedPreceding, 0)
    ended, begins = F.max(F.when(~F.col("hit"), F.col("end"))).over(forth), F.min(F.when(~F.col("hit"), F.col("start"))).over(back)
    marked = every.withColumns({"ended": ended, "begins": begins}).where("hit")
    clear = F.coalesce(F.col("ended") <= F.col("start"), F.lit(True)) & F.coalesce(
        (F.col("begins") >= F.col("end")) | (F.col("begins") < F.col("start")),
        F.lit(True),
    )
    return marked.where(clear).drop("hit", "ended", "begins")


def all_spans(found: DataFrame) -> DataFrame:
    """found with spans: base spans, and those of revealing terms outside them, each with its label."""
    terms = broadcast_if_small(materialize(disclosures(found).select("term", "kind", "label"), "revealing"))
    words = F.array_distinct(F.transform(words_of(F.col("_text")), lambda w: F.lower(w)))
    some = materialize(found.select("rid", F.explode_outer(words).alias("term")).join(terms, "term"), "documents-with-terms")
    held = found.join(broadcast_if_small(some.select("rid").distinct()), "rid", "left_semi")
    hits = placed_words(held.select("rid", "_text")).join(some, ["rid", "term"]).select("rid", "start", "end", "kind", "label")
    base = held.select("rid", F.explode("base").alias("s")).select("rid", "s.start", "s.end")
    more = apart(hits, base).groupBy("rid").agg(F.collect_list(F.struct("start", "kind", "end", "label")).alias("more"))
    out = found.join(broadcast_if_small(materialize(more, "term-spans")), "rid", "left")
    labels = F.array(*map(F.lit, LABELS))
    plain = F.transform(
        "base",
        lambda x: F.struct(
            x["start"].alias("start"),
            x["kind"].alias("kind"),
            x["end"].alias("end"),
            F.get(labels, x["kind"]).alias("label"),
        ),
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int,label:string>>")
    return out.withColumn("spans", F.array_sort(F.concat(plain, F.coalesce("more", none)))).drop("more")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms."""
    found = all_spans(found_in(docs, [F.col("doc_id")]))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    digest = F.sha2(spelled(F.col("base")).cast("binary"), 256)
    more = (F.size("spans") - F.size("base")).cast("long")
    return found.select(
        "doc_id",
        *map(count, range(4)),
        digest.alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"),
        more.alias("n_terms"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its label; of spans that overlap, the first one's. A piece of the text goes
    with each chunk of spans."""

    def step(of: Column, a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        gap = F.substr(of["piece"], a["at"] - of["from"] + 1, s["start"] - a["at"])
        more = F.when(fresh, F.concat(a["out"], F.array(gap, s["label"]))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), more.alias("out"))

    none = F.array().cast("array<string>")

    def chunk(whole: Column, a: Column, own: Column) -> Column:
        # From where the text is written so far to where the chunk's last span begins.
        last = F.greatest(a["at"], F.element_at(own, -1)["start"])
        of = F.struct(a["at"].alias("from"), F.substr(whole, a["at"] + 1, last - a["at"]).alias("piece"))
        done = let(of, lambda o: F.aggregate(own, F.struct(a["at"].alias("at"), none.alias("out")), lambda b, s: step(o, b, s)))
        return let(
            done,
            lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], F.array(F.array_join(r["out"], ""))).alias("out")),
        )

    def whole(x: Column) -> Column:
        rest = lambda a: F.concat(F.array_join(a["out"], ""), F.substr(x["text"], a["at"] + 1, F.length(x["text"])))
        return F.aggregate(
            in_chunks(x["spans"]),
            F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda a, own: chunk(x["text"], a, own),
            rest,
        )

    return let(F.struct(text.alias("text"), spans.alias("spans")), whole)


def sanitise(docs: DataFrame) -> DataFrame:
    """All documents and columns, with the spans in text replaced; texts without spans, null too, stay as they are."""
    null = "_null"
    while null in docs.columns:
        null += "_"
    others = F.struct(F.col("text").isNull().alias(null), *[column(c) for c in docs.columns if c != "text"]).alias("row")
    found = all_spans(found_in(docs, [others]))
    text = F.when(
        F.size("spans") > 0,
        redacted(F.col("_text"), F.col("spans")),
    ).when(~column(null, "row"), F.col("_text")).alias("text")
    return found.select(*[text if c == "text" else column(c, "row") for c in docs.columns])
