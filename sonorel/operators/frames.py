"""Frames: building, validating, selecting, and the relations among them.

A stream of frames is a DataFrame of schema.FRAME whose order is `pos`. Every
operator takes and gives DataFrames; none relies on the order of partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonorel import schema as S
from sonorel.functions.identity import frame_id_udf
from sonorel.storage import materialize

NULLS = {c.split()[0]: c.split()[1] for c in S.FRAME.split(", ")}


def frame(df: DataFrame, **columns: Column) -> DataFrame:
    """Rows of the envelope from expressions; fields that aren't given are null."""
    given = {"v": F.lit(S.VERSION)} | columns
    return df.select(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in NULLS.items()])


def _json(value: Column) -> Column:
    """Text as a JSON string."""
    listed = F.to_json(F.array(value))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def defining_json() -> Column:
    """The fields that define a frame, as one JSON object. The data of text frames is text; that of others, like params, is JSON."""
    c = F.col
    data = F.when(c("kind") == "text", _json(c("data"))).otherwise(c("data"))
    values = {n: _json(c(n)) for n in ("kind", "role", "of", "op", "op_version", "hash")}
    values |= {"lineage": F.to_json("lineage"), "params": c("params"), "data": data}
    members = [F.when(c(n).isNotNull(), F.concat(F.lit(f'"{n}":'), value)) for n, value in values.items()]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*members)), ","), F.lit("}"))


def stamped(frames: DataFrame) -> DataFrame:
    """Frames with an id: what they are decides it, so equal frames of different streams share one. Ids that are there stay."""
    return frames.withColumn("id", F.coalesce("id", frame_id_udf(defining_json())))


COMMON = ("pos", "role", "of", "lineage", "op", "op_version", "params", "seq")


def _made(df: DataFrame, kind: str, own: dict[str, Column], common: dict[str, Column], also: tuple[str, ...] = ()) -> DataFrame:
    wrong = set(common) - {*COMMON, *also}
    if wrong:
        raise TypeError(f"{kind} frames have no {', '.join(sorted(wrong))}")
    return stamped(frame(df, kind=F.lit(kind), **own, **common))


def audio_frames(
    df: DataFrame,
    hash: Column,
    sr: Column,
    ch: Column,
    dur: Column,
    media: Column | None = None,
    bits: Column | None = None,
    fmt: Column | None = None,
    **common: Column,
) -> DataFrame:
    """A blob of samples. Rate, channels, seconds and, where given, bits and format are its meta."""
    given = {"sr": sr, "ch": ch, "dur": dur, "bits": bits, "fmt": fmt}
    meta = F.to_json(F.struct(*[value.alias(name) for name, value in given.items() if value is not None]))
    return _made(df, "audio", {"hash": hash, "media": F.lit("audio/wav") if media is None else media, "meta": meta}, common)


def text_frames(df: DataFrame, text: Column, **common: Column) -> DataFrame:
    return _made(df, "text", {"data": text}, {"role": F.lit("caption")} | common)


def feature_frames(df: DataFrame, data: Column, **common: Column) -> DataFrame:
    """data: a struct or map of measures."""
    return _made(df, "feature", {"data": F.to_json(data)}, common)


def marker_frames(df: DataFrame, points: Column, **common: Column) -> DataFrame:
    """points: an array of schema.POINT, or of some of its fields."""
    return _made(df, "marker", {"data": F.to_json(points)}, {"role": F.lit("onset")} | common)


def image_frames(
    df: DataFrame,
    hash: Column,
    media: Column | None = None,
    meta: Column | None = None,
    **common: Column,
) -> DataFrame:
    own = {"hash": hash, "media": F.lit("image/png") if media is None else media}
    return _made(df, "image", own | ({} if meta is None else {"meta": F.to_json(meta)}), {"role": F.lit("spectrogram")} | common)


def verdict_frames(
    df: DataFrame,
    data: Column,
    of: Column,
    lineage: Column,
    schema_version: Column,
    **common: Column,
) -> DataFrame:
    """A judgment of an audio frame: lineage names the feature frames and the profile that it comes from."""
    return _made(
        df,
        "verdict",
        {"data": F.to_json(data), "schema_version": schema_version},
        {"of": of, "lineage": lineage} | common,
    )


def vector_frames(
    df: DataFrame,
    model: Column,
    dim: Column,
    vector: Column | None = None,
    hash: Column | None = None,
    dtype: str = "float32",
    **common: Column,
) -> DataFrame:
    """Short vectors are inline, longer ones name a blob: a row must have exactly one of vector and hash."""
    none = F.lit(None)
    vector, hash = none.cast("array<float>") if vector is None else vector, none.cast("string") if hash is None else hash
    bad = F.when(vector.isNull() == hash.isNull(), F.raise_error(F.lit("a vector frame needs either a vector or a hash")))
    meta = F.to_json(F.struct(model.alias("model"), dim.alias("dim"), F.lit(dtype).alias("dtype")))
    own = {
        "meta": F.coalesce(bad, meta),
        "data": F.to_json(vector),
        "hash": hash,
        "media": F.when(hash.isNotNull(), "application/x-npy"),
    }
    return _made(df, "vector", own, common)


def error_frame(df: DataFrame, code: Column, message: Column, of: Column, op: Column, pos: Column | None = None) -> DataFrame:
    data = F.to_json(F.struct(code.alias("code"), message.alias("message"), of.alias("of"), op.alias("op")))
    place = {} if pos is None else {"pos": pos}
    return stamped(frame(df, kind=F.lit("error"), of=of, op=op, data=data, **place))


def problems() -> Column:
    """array<string>: what is wrong with a frame."""
    c = F.col
    has_hash, has_data = c("hash").isNotNull(), c("data").isNotNull()
    code, message = F.get_json_object("data", "$.code"), F.get_json_object("data", "$.message")
    dim = F.get_json_object("meta", "$.dim").cast("int")
    rollup, said = F.get_json_object("data", "$.rollup"), F.get_json_object("data", "$.rollup.decision")
    rules = [
        (c("v").isNull(), "missing v"),
        (c("v") > S.VERSION, "v not supported"),
        (c("kind").isNull(), "missing kind"),
        (c("id").isNull(), "missing id"),
        (has_hash & has_data, "hash and data"),
        (has_hash & (F.coalesce("media", F.lit("")) == ""), "hash without media"),
        (has_hash & ~c("hash").rlike(S.HASH_PATTERN), "malformed hash"),
        (has_data & (F.octet_length("data") > S.MAX_INLINE_BYTES), "inline data too large"),
        (c("kind").isin(*S.HEAVY_KINDS) & ~has_hash & ~has_data, "no payload"),
        ((c("kind") == "error") & ~F.coalesce(code.isin(*S.ERROR_CODES), F.lit(False)), "error code not known"),
        (
            (c("kind") == "error") & F.coalesce(code.isin(*S.ERROR_CODES), F.lit(False)) & (F.coalesce(message, F.lit("")) == ""),
            "error without message",
        ),
        ((c("kind") == "verdict") & (F.coalesce("schema_version", F.lit("")) == ""), "verdict without schema_version"),
        ((c("kind") == "verdict") & ~F.coalesce(rollup.startswith("{"), F.lit(False)), "verdict without rollup"),
        (
            (c("kind") == "verdict") & F.coalesce(rollup.startswith("{"), F.lit(False)) & ~F.coalesce(said.isin(*S.DECISIONS), F.lit(False)),
            "decision not known",
        ),
        ((c("kind") == "vector") & dim.isNull(), "vector without dim"),
        ((c("kind") == "vector") & has_data & (dim > S.MAX_INLINE_DIM), "inline vector too long"),
    ]
    return F.filter(
        F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for rule, name in rules]),
        lambda x: x.isNotNull(),
    )


def validate(frames: DataFrame) -> DataFrame:
    return frames.withColumn("problems", problems())


def matching(frames: DataFrame, role: str | None = None, kind: str | None = None, predicate: Column | None = None) -> DataFrame:
    for test in (
        [F.col("role") == role] if role is not None else []
    ) + ([F.col("kind") == kind] if kind is not None else []) + ([predicate] if predicate is not None else []):
        frames = frames.where(test)
    return frames


def select(
    frames: DataFrame,
    role: str | None = None,
    kind: str | None = None,
    predicate: Column | None = None,
    mode: str = "last",
    by: tuple[str, ...] = (),
) -> DataFrame:
    """The last match (by seq where every match of the stream has one, else by pos), all of them in order (column `place`), or, strict, the only one.

    by: columns that name streams; none, if the frames are one stream. strict raises when it runs if a stream has several matches."""
    found = matching(frames, role, kind, predicate)
    if mode == "all":
        whole = Window.partitionBy(*by) if by else None
        if whole is None:
            every = found.agg(F.bool_and(F.col("seq").isNotNull()).alias("_all"))
            keyed = found.join(F.broadcast(every))
        else:
            keyed = found.withColumn("_all", F.bool_and(F.col("seq").isNotNull()).over(whole))
        return keyed.withColumn(
            "place",
            F.struct(F.when(F.col("_all"), F.col("seq")).otherwise(F.col("pos")).alias("k"), "pos"),
        ).drop("_all")
    row = F.struct(*[F.col(c) for c in frames.columns])
    picked = found.groupBy(*by).agg(
        F.bool_and(F.col("seq").isNotNull()).alias("_all"),
        F.count("*").alias("_n"),
        F.max_by(row, F.struct("seq", "pos")).alias("_by_seq"),
        F.max_by(row, "pos").alias("_by_pos"),
    )
    best = F.when(F.col("_all"), F.col("_by_seq")).otherwise(F.col("_by_pos"))
    if mode == "strict":
        best = F.when(
            F.col("_n") > 1,
            F.raise_error(F.concat(F.lit("strict: "), F.col("_n"), F.lit(" frames match"))),
        ).otherwise(best)
    return picked.where("_n > 0").select(best.alias("_f")).select("_f.*")


def select_stage(
    frames: DataFrame,
    role: str | None = None,
    kind: str | None = None,
    mode: str = "last",
    ids_only: bool = False,
) -> DataFrame:
    """The stream of frames, followed by a marker frame of role `selected` that names the matches; ids_only: the matches
    alone. Where strict finds several, an error frame follows instead."""
    if role is None and kind is None:
        raise ValueError("a selection needs a role or a kind")
    several = mode == "strict" and matching(frames, role, kind).limit(2).count() > 1
    if several:
        text = F.lit(f"strict: several frames match {role or kind}")
        one = frames.sparkSession.range(1)
        return passthrough(
            frames,
            error_frame(
                one,
                F.lit("op_failed"),
                text,
                F.lit(None).cast("string"),
                F.lit("select"),
            ).withColumn("pos", F.lit(0).cast("bigint")),
        )
    found = select(frames, role, kind, mode="last" if mode == "strict" else mode).select(*frames.columns)
    if ids_only:
        return found
    ids = found.agg(F.array_sort(F.collect_set("id")).alias("ids"))
    told = [F.lit(v).cast("string").alias(n) for n, v in (("role", role), ("kind", kind), ("mode", mode))]
    params = F.to_json(F.struct(*told, F.col("ids").alias("matched")), {"ignoreNullFields": "false"})
    points = F.transform("ids", lambda i: F.struct(i.alias("label")))
    marker = marker_frames(
        ids,
        points,
        pos=F.lit(0),
        role=F.lit("selected"),
        op=F.lit("select"),
        op_version=F.lit("select@1"),
        params=params,
    )
    return passthrough(frames, marker)


def audio_for_stage(frames: DataFrame, role: str | None = None, by: tuple[str, ...] = (), everything: bool = True) -> DataFrame:
    """Audio of the role; where the role matches none, all audio. everything=False: the last only."""
    audio = matching(frames, kind="audio")
    if role is not None:
        hit = audio.groupBy(*by).agg(
            F.count_if(F.col("role") == role).alias("_hit")
        ) if by else audio.agg(F.count_if(F.col("role") == role).alias("_hit"))
        audio = audio.join(hit, list(by)) if by else audio.join(F.broadcast(hit))
        audio = audio.where((F.col("_hit") == 0) | (F.col("role") == role)).drop("_hit")
    return audio if everything else select(audio, by=by)


def edges(frames: DataFrame) -> DataFrame:
    """child, parent, pos: of and lineage."""
    parents = F.array_compact(F.concat(F.array("of"), F.coalesce("lineage", F.array().cast("array<string>"))))
    return frames.select(F.col("id").alias("child"), F.explode(F.array_distinct(parents)).alias("parent"), "pos")


def ancestors(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """child, ancestor: the transitive closure, safe with cycles. Paths double in length each round, so depth d takes log2(d) rounds."""
    reached = edges.select("child", F.col("parent").alias("ancestor")).distinct()
    n = reached.count()
    for _ in range(most_rounds):
        step = reached.alias("a").join(
            reached.alias("b"),
            F.col("a.ancestor") == F.col("b.child"),
        ).select("a.child", "b.ancestor")
        reached = materialize(reached.union(step).distinct(), "reached")
        now = reached.count()
        if now == n:
            return reached
        n = now
    raise ValueError("the lineage is deeper than the rounds allow")


def reached_from(edges: DataFrame, start: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """ancestor: what the frames of start (ancestor) come from, themselves included. A round climbs one step from what is new, so only their own lineage is ever read together."""
    known = new = materialize(start.distinct(), "reached")
    for _ in range(most_rounds):
        step = edges.join(
            new,
            F.col("child") == F.col("ancestor"),
            "left_semi",
        ).select(F.col("parent").alias("ancestor")).distinct()
        new = materialize(step.join(known, "ancestor", "left_anti"), "reached")
        if not new.take(1):
            return known
        known = known.union(new)
    raise ValueError("the lineage is deeper than the rounds allow")


def resolve_audio(frames: DataFrame, role: str | None = None) -> DataFrame:
    """One row: the last audio frame with a hash, or the code and message of the error that explains why there is none."""
    audio = select(frames, role=role, kind="audio", predicate=F.coalesce("hash", F.lit("")) != "")
    of = F.coalesce(F.get_json_object("data", "$.of"), F.col("of"))
    errors = frames.where("kind = 'error'").select(
        "pos",
        of.alias("of"),
        "role",
        F.get_json_object("data", "$.role").alias("data_role"),
        F.coalesce(F.get_json_object("data", "$.code"), F.lit("op_failed")).alias("code"),
        F.coalesce(F.get_json_object("data", "$.message"), F.lit("upstream op failed")).alias("message"),
    )
    targets = (frames if role is None else frames.where(F.col("role") == role)).select("id").where("id is not null").distinct()
    reached = reached_from(
        edges(frames),
        targets.select(F.col("id").alias("ancestor")),
    ).select(F.col("ancestor").alias("of")).withColumn("hit", F.lit(True))
    asked = F.lit(role).cast("string")
    causes = errors.join(reached, "of", "left").select(
        F.when(F.col("hit"), 0).when(F.col("role").eqNullSafe(asked) | F.col("data_role").eqNullSafe(asked), 1).alias("tier"),
        "pos",
        "code",
        "message",
    ).where("tier is not null")
    cause = causes.agg(F.min_by(F.struct("code", "message"), F.struct("tier", "pos")).alias("c"))
    found = audio.agg(F.max_by(F.struct("id", "hash"), "pos").alias("a"))
    none = F.struct(F.lit("not_found").alias("code"), F.lit("no resolvable audio frame").alias("message"))
    said = F.when(F.col("a").isNull(), F.coalesce("c", none))
    return found.join(F.broadcast(cause)).select("a.id", "a.hash", said["code"].alias("code"), said["message"].alias("message"))


# Conformance: each check gives the violations.


def dropped(before: DataFrame, after: DataFrame) -> DataFrame:
    """Frames of the input that the output doesn't pass through."""
    return before.join(after.select("id"), "id", "left_anti").select("id")


def dangling(frames: DataFrame, blobs: DataFrame | None = None) -> DataFrame:
    """child, parent: references to frames (or blobs) that don't exist."""
    out = edges(frames).join(frames.select(F.col("id").alias("parent")).distinct(), "parent", "left_anti")
    if blobs is not None:
        out = out.join(blobs.select(F.col("hash").alias("parent")), "parent", "left_anti")
    return out.select("child", "parent")


def out_of_order(frames: DataFrame) -> DataFrame:
    """child, parent: references to frames that come later."""
    first = frames.groupBy(F.col("id").alias("parent")).agg(F.min("pos").alias("first"))
    return edges(frames).join(first, "parent").where("first >= pos").select("child", "parent")


def collisions(frames: DataFrame) -> DataFrame:
    """id, shapes: ids under which different frames go, seq and consumed aside."""
    shape = F.xxhash64(
        *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in NULLS if c not in ("pos", "seq", "consumed", "raw")]
    )
    return frames.where("id is not null").groupBy("id").agg(F.count_distinct(shape).alias("shapes")).where("shapes > 1")


def duplicate_ids(frames: DataFrame) -> DataFrame:
    """id: those that different frames carry. Frames that repeat whole are no collision."""
    return collisions(frames).select("id")


def check_all(before: DataFrame, after: DataFrame, blobs: DataFrame | None = None) -> DataFrame:
    """check, id, other: every violation of a stage's contract, from its input and output."""
    none = F.lit(None).cast("string")
    rows = lambda df, check, a, b=none: df.select(
        F.lit(check).alias("check"),
        F.col(a).alias("id"),
        b.alias("other"),
    )
    found = rows(dropped(before, after), "passthrough", "id")
    found = found.union(rows(dangling(after, blobs), "lineage", "child", F.col("parent")))
    found = found.union(rows(out_of_order(after), "ordering", "child", F.col("parent")))
    return found.union(rows(duplicate_ids(after), "id_collision", "id"))


# The blob store as a table.


def put_blobs(store: DataFrame, new: DataFrame) -> DataFrame:
    """The blobs that the store lacks, each once: append these."""
    return new.dropDuplicates(["hash"]).join(store.select("hash"), "hash", "left_anti")


def collect_garbage(blobs: DataFrame, refs: DataFrame, grace_seconds: float = 3600.0) -> DataFrame:
    """hash, fate: kept (referenced), reserved (younger than the grace), or removed. blobs: hash, age_seconds."""
    live = refs.select("hash").distinct().withColumn("live", F.lit(True))
    return blobs.join(live, "hash", "left").select(
        "hash",
        F.when(F.col("live"), "kept").when(F.col("age_seconds") < grace_seconds, "reserved").otherwise("removed").alias("fate"),
    )


def blob_path(hash_: Column, media: Column, ext: Column | None = None) -> Column:
    """Where a blob lies in its store: a folder by the hash's first two digits. A hash or an extension that isn't plainly one is refused, so that none leads out of the store."""
    ext = extension(media) if ext is None else ext
    bad = F.when(
        ~F.coalesce(hash_.rlike(S.HASH_PATTERN), F.lit(False)),
        F.raise_error(F.concat(F.lit("not a hash: "), F.coalesce(hash_, F.lit("null")))),
    )
    bad = bad.when(
        ~F.coalesce(ext.rlike(S.EXTENSION_PATTERN), F.lit(False)),
        F.raise_error(F.concat(F.lit("unsafe extension: "), F.coalesce(ext, F.lit("null")))),
    )
    digits = F.substring(hash_, 8, 64)
    return F.coalesce(bad.cast("string"), F.concat_ws("/", F.substring(digits, 1, 2), F.concat_ws(".", digits, ext)))


def remove_garbage(fates: DataFrame, root: str, dry_run: bool = True) -> DataFrame:
    """fate, n: what collect_garbage found. Unless it is a dry run, the files of removed blobs are deleted first, by the
    tasks that hold their rows; one that is gone already counts as removed. fates: fate, path (under the root)."""
    if not dry_run:

        def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, base = fs.FileSystem.from_uri(root)
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    try:
                        files.delete_file(f"{base}/{path}")
                    except FileNotFoundError:
                        pass
                yield batch

        materialize(fates.where("fate = 'removed'").select("path").mapInArrow(delete, "path string"), "removed")
    return fates.groupBy("fate").agg(F.count("*").alias("n"))


def split_by_memo(inputs: DataFrame, memo: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with their cached columns, misses): only misses go on to costly work."""
    return inputs.join(memo, "memo_key"), inputs.join(memo.select("memo_key"), "memo_key", "left_anti")


def passthrough(before: DataFrame, derived: DataFrame) -> DataFrame:
    """The input followed by what was derived: positions of the derived follow the input's last."""
    last = before.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("_last"))
    moved = derived.join(F.broadcast(last)).withColumn("pos", F.col("pos") + F.col("_last") + 1).drop("_last")
    return before.unionByName(moved)


def scalar(data: Column, path: str = "$") -> Column:
    """A number as it is; {mean}, or else {median} or {p50}, of an object; null for booleans, text and what isn't finite."""
    got = F.get_json_object(data, path)
    number = F.when(got.rlike(r"^-?[0-9]"), got.try_cast("double"))
    inner = F.coalesce(*[F.get_json_object(got, f"$.{k}").try_cast("double") for k in ("mean", "median", "p50")])
    x = F.when(got.startswith("{"), inner).otherwise(number)
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def unit_of(key: Column) -> Column:
    k = F.lower(key)
    leaf = F.element_at(F.split(k, r"\."), -1)
    by_leaf = [F.when(leaf == n, u) for n, u in S.LEAF_UNITS.items()]
    by_ending = [F.when(k.endswith(e), u) for e, u in S.ENDING_UNITS.items()]
    rest = F.when(k.startswith("timbre."), "0–100").when(
        (k == "rhythm.bpm") | k.endswith(".bpm"),
        "BPM",
    ).when(k.endswith("confidence"), "0–1").otherwise("")
    return F.coalesce(*by_leaf, *by_ending, rest)


def short_key(key: Column) -> Column:
    """The part of a key that tells it apart: width.x.correlation as x.corr, spectrum.band.x as x, else the last part."""
    part = lambda k: F.get(F.split(key, r"\."), F.lit(k))
    tail = F.replace(F.replace(part(2), F.lit("correlation"), F.lit("corr")), F.lit("side_mid_ratio"), F.lit("smr"))
    three = part(2).isNotNull() & part(0).isin("spectrum", "width")
    return F.when(
        three & part(1).isin("band", "oct6"),
        part(2),
    ).when(three, F.concat_ws(".", part(1), tail)).otherwise(F.element_at(F.split(key, r"\."), -1))


def candidate_label(name: Column, source: Column, role: Column, hash_: Column, number: Column) -> Column:
    base = F.regexp_extract(source, r"([^/]+)/*$", 1)
    return F.coalesce(
        F.when(name != "", name),
        F.when(base != "", base),
        F.when((role != "source") & (role != ""), role),
        F.when(hash_.isNotNull(), F.substring(F.regexp_replace(hash_, "^[a-z0-9]+:", ""), 1, 8)),
        F.concat(F.lit("cand-"), number.cast("string")),
    )


def wet_role(role: Column) -> Column:
    return F.concat(F.regexp_replace(F.coalesce(role, F.lit("edit")), r"[.](wet|dry)$", ""), F.lit(".wet"))


def extension(media: Column) -> Column:
    return F.coalesce(*[F.when(media == m, e) for m, e in S.EXTENSIONS.items()], F.lit("bin"))
