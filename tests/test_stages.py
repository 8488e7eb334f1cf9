"""Stages that read and write files, and kernels that no query covers."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonorel.functions.blake3 import blake3, blake3_many
from sonorel.operators import edits as E
from sonorel.operators import frames as R
from sonorel.operators import stages, vectors
from sonorel.sources import recipes, records, wav

RATE = 8000


def files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, hz in (("b", 440), ("a", 220)):
        (tmp_path / "in" / f"{name}.wav").write_bytes(wav.encode(recipes.tone(hz, 0.1, 0.5, RATE), RATE, "PCM_16"))
    (tmp_path / "in" / "c.wav").write_bytes(b"RIFF")
    return spark.read.format("binaryFile").load(str(tmp_path / "in")).select("path", "content")


def test_files_become_frames_and_files_again(spark, tmp_path):
    found = files(spark, tmp_path)
    inbound = R.text_frames(spark.createDataFrame([(0, "hello")], "pos bigint, t string"), F.col("t"), pos=F.col("pos"))
    frames = stages.read_stage(found, inbound=inbound).orderBy("pos").collect()
    assert [(r.pos, r.kind) for r in frames] == [(0, "text"), (1, "audio"), (2, "audio"), (3, "error")]
    stream = stages.read_stage(found, inbound=inbound)
    records.write_frames(stream, str(tmp_path / "stream"))
    back = stages.checked_stream(spark, str(tmp_path / "stream"))
    assert {(r.id, r.kind) for r in back.collect()} == {(r.id, r.kind) for r in frames}
    out = tmp_path / "out" / "x.wav"
    signals = wav.decoded(found)
    stages.write_stage(back, signals, f"file://{out}", encoding="PCM_16")
    assert out.read_bytes() == (tmp_path / "in" / "b.wav").read_bytes()
    with pytest.raises(ValueError, match="strict"):
        stages.write_stage(back, signals, f"file://{out}", strict=True)
    with pytest.raises(LookupError, match="not_found"):
        stages.write_stage(back.where("kind = 'text'"), signals, f"file://{out}")


def test_colliding_ids_are_refused(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"v":1,"kind":"text","id":"x","data":"a"}\n{"v":1,"kind":"text","id":"x","data":"b"}\n')
    with pytest.raises(ValueError, match="id_collision.*x"):
        stages.checked_stream(spark, str(tmp_path / "s.jsonl"))


def test_headers_beyond_the_head_are_found(spark):
    whole = wav.encode(recipes.tone(440, 0.1, 0.5, RATE), RATE, "PCM_16")
    note = b"LIST" + (200_000).to_bytes(4, "little") + b"data" * 50_000
    late = whole[:12] + whole[12:36] + note + whole[36:]
    rows = [
        ("late", bytearray(late)),
        ("plain", bytearray(whole)),
        ("none", bytearray(b"RIFF" + b"x" * 100_000)),
        ("nothing", None),
    ]
    got = {r.path: (r.sr, r.n) for r in wav.probed(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"late": (RATE, 800), "plain": (RATE, 800), "none": (None, None), "nothing": (None, None)}


def test_garbage_goes_unless_it_is_a_dry_run(spark, tmp_path):
    rows = []
    for k, age in enumerate((9000.0, 9000.0, 10.0)):
        path = f"{k}{k}/{k}.bin"
        os.makedirs(tmp_path / f"{k}{k}")
        (tmp_path / path).write_bytes(b"x")
        rows.append((f"h{k}", age, path))
    blobs = spark.createDataFrame(rows, "hash string, age_seconds double, path string")
    fates = R.collect_garbage(blobs, blobs.where("hash = 'h1'")).join(blobs.select("hash", "path"), "hash")
    for dry in (True, False):
        got = {r.fate: r.n for r in R.remove_garbage(fates, f"file://{tmp_path}", dry_run=dry).collect()}
        assert got == {"removed": 1, "kept": 1, "reserved": 1}
        assert (tmp_path / "00/0.bin").exists() == dry and (tmp_path / "11/1.bin").exists() and (tmp_path / "22/2.bin").exists()
    with pytest.raises(Exception, match="unsafe extension"):
        spark.range(1).select(R.blob_path(F.lit("blake3:" + "0" * 64), F.lit(""), F.lit("../x"))).collect()


def test_selection_stages(spark):
    rows = [(i, f"t{i}", "lead" if i % 2 else None) for i in range(6)]
    df = spark.createDataFrame(rows, "pos bigint, t string, r string")
    frames = R.text_frames(df, F.col("t"), role=F.col("r"), pos=F.col("pos"))
    ids = [r.id for r in frames.where("role = 'lead'").orderBy("pos").collect()]
    marker = R.select_stage(frames, role="lead", mode="all").orderBy("pos").collect()[-1]
    assert (marker.kind, marker.role, marker.op) == ("marker", "selected", "select")
    assert sorted(__import__("json").loads(marker.params)["matched"]) == sorted(ids)
    assert [r.id for r in R.select_stage(frames, role="lead", ids_only=True).collect()] == ids[-1:]
    wrong = R.select_stage(frames, role="lead", mode="strict").orderBy("pos").collect()[-1]
    assert wrong.kind == "error" and "op_failed" in wrong.data
    with pytest.raises(ValueError):
        R.select_stage(frames)


def test_queries_in_blocks_equal_one_block(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 12))
    df = spark.createDataFrame(
        [(i, x.tolist()) for i, x in enumerate(v)] + [(900, [1.0, 2.0]), (901, None)],
        "id bigint, vector array<double>",
    ).repartition(4)
    index, queries = vectors.build_index(df), df.where("id % 7 = 0 or id >= 900")
    one = sorted(map(tuple, vectors.query_index(index, queries, 5).collect()))
    assert one == sorted(map(tuple, vectors.query_index(index, queries, 5, block=10).collect()))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    for query, rank, name, score in one:
        if query < 900:
            best = np.lexsort((np.arange(300), -np.round(unit @ unit[query], 6)))
            assert best[rank - 1] == name and abs(score - unit[name] @ unit[query]) < 1e-6
    assert [r[2] for r in one if r[0] == 900] == [900]


def test_many_hashes_equal_single_ones():
    inputs = [
        bytes((7 * n + k) % 251 for k in range(n)) for n in (
            0,
            1,
            64,
            65,
            1023,
            1024,
            1025,
            2048,
            2049,
            3072,
            5000,
            7168,
            8193,
            31_744,
        )
    ]
    assert blake3_many(inputs) == [blake3(x) for x in inputs]


def test_rooms_ring_longer_the_larger_they_are():
    x = np.zeros((4000, 1))
    x[0] = 0.9
    energy = [float((E.reverb(x, RATE, amount)[4000:] ** 2).sum()) for amount in (0, 50, 100)]
    assert 0 < energy[0] < energy[1] < energy[2]
