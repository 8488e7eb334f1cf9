"""Signals: published hashes, analytic values, and properties of edits."""

import numpy as np
import pytest

from sonorel.functions.blake3 import blake3
from sonorel.functions.identity import canonical_json, frame_id, memo_key, signal_hash
from sonorel.operators import dsp as D
from sonorel.operators import edits as E
from sonorel.operators import features as Fe
from sonorel.sources import wav

RATE = 44_100
T = np.arange(2 * RATE) / RATE
TONE = 0.5 * np.sin(2 * np.pi * 1000 * T)[:, None]
NOISE = np.random.default_rng(5).normal(size=(RATE, 2)) * 0.1


def golden(kind, n=800, rate=8000):
    if kind == "stereo":
        return np.stack([np.linspace(-1, 1, n, dtype=np.float32), np.linspace(1, -1, n, dtype=np.float32)], 1)
    x = {
        "silence": np.zeros(n, np.float32),
        "dc": np.full(n, 0.25, np.float32),
        "sine": (0.5 * np.sin(2 * np.pi * 440.0 * (np.arange(n) / rate))).astype(np.float32),
        "ramp": np.linspace(-1, 1, n, dtype=np.float32),
        "third": np.full(n, 1 / 3),
    }[kind]
    return x[:, None]


# Fixed values of the published conformance corpus.
GOLDEN = [
    ("silence", "FLOAT", "85157125b381a2aa60b4db1a5f4336f6d722e4df25dc64f9028e81ff93a033ea"),
    ("dc", "FLOAT", "e4b450d61d3282fe2cff6918fee8fe12cc447ff02ab2fd93eb3607edad510a21"),
    ("sine", "FLOAT", "2f5c977cafeed3521597ce198e6d5c5a592c0cee32f9e60d7197723c777fe39d"),
    ("ramp", "FLOAT", "47a9498d3c25b344e4d8dcce9cc922accac94087e6913a7cf1529763b5af54aa"),
    ("ramp", "PCM_16", "e6cf482438becee1a7de96750fab88cf09a5e7087bed3994c8f40f7f77f6ac95"),
    ("ramp", "PCM_24", "a2e5fac038771448106c90db99da7d88cdf0d45c8ad5aaee286c08af2dad933b"),
    ("third", "DOUBLE", "c11eb728fe5b32849563055863e8e2d544757c61a39252a577b8559abc8bfb16"),
    ("stereo", "FLOAT", "4e97447b519d2db88016d5408057bc344332c968c2183bd3cee703084d44a536"),
]


@pytest.mark.parametrize("kind,encoding,digest", GOLDEN)
def test_golden_hashes(kind, encoding, digest):
    assert signal_hash(*wav.decode(wav.encode(golden(kind), 8000, encoding))) == f"blake3:{digest}"


def test_blake3_of_nothing_and_of_many_chunks():
    assert blake3(b"") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3(bytes(i % 251 for i in range(102_400))) == "bc3e3d41a1146b069abffad3c0d44860cf664390afce4d9661f7902e7943e085"


def test_identity_ignores_what_does_not_define():
    f = {"kind": "text", "data": "x", "seq": 3, "v": 1}
    assert frame_id(f) == frame_id(f | {"seq": 4, "media": "m"}) != frame_id(f | {"data": "y"})
    assert canonical_json({"b": 6.0, "a": [1.5, float("nan")]}) == '{"a":[1.5,"__float__:nan"],"b":6}'
    assert memo_key("o", "1", ["b", "a"], {"x": 1.0}) == memo_key("o", "1", ["a", "b"], {"x": 1}) != memo_key("o", "2", ["a", "b"], {"x": 1})
    assert memo_key("o", "1", [], {}, defaults={"x": 1}) == memo_key("o", "1", [], {"x": 1})


def test_filters_have_their_corner_at_three_decibels():
    def level(sections, hz):
        z, h = np.exp(2j * np.pi * hz / RATE), 1
        for b, a in sections:
            h *= (b[0] + b[1] / z + b[2] / z**2) / (a[0] + a[1] / z + a[2] / z**2)
        return 20 * np.log10(abs(h))

    for order in (2, 3, 4):
        assert level(D.butterworth(order, 1000, RATE, "low"), 1000) == pytest.approx(-3.0103, abs=1e-3)
        assert level(D.butterworth(order, 1000, RATE, "high"), 10_000) == pytest.approx(0, abs=0.01)
    assert level(D.butterworth(4, (500, 2000), RATE, "band"), 500) == pytest.approx(-3.0103, abs=1e-3)


def test_biquad_equals_the_plain_recursion():
    (b, a), *_ = D.butterworth(2, 900, RATE, "low")
    x = NOISE[:700]
    y = np.zeros_like(x)
    for n in range(len(x)):
        y[n] = sum(b[k] * x[n - k] for k in range(3) if n >= k) - sum(a[k] * y[n - k] for k in (1, 2) if n >= k)
    assert np.allclose(y, D.biquad(x, b, a), atol=1e-12)


def test_loudness_follows_gain_and_tone():
    a, b = D.integrated(TONE, RATE), D.integrated(TONE / 2, RATE)
    assert a == pytest.approx(-9.07, abs=0.1) and a - b == pytest.approx(6.02, abs=0.02)
    assert D.true_peak(TONE)[0] == pytest.approx(-6.02, abs=0.1)
    assert D.integrated(np.zeros((RATE, 1)), RATE) is None and D.integrated(TONE[:100], RATE) is None


def test_space_and_width_tell_mono_from_antiphase():
    two = np.repeat(TONE, 2, axis=1)
    assert Fe.space(two, RATE)["space.mono_collapse_penalty_db"] == 0
    assert Fe.space(two * [1, -1], RATE)["space.mono_collapse_penalty_db"] == 60
    assert Fe.space(NOISE, RATE)["space.mono_collapse_penalty_db"] == pytest.approx(3, abs=0.3)
    assert Fe.width(TONE, RATE)["width.full.correlation"] == 1.0
    assert Fe.stereo_correlation(two * [1, -1]) == pytest.approx(-1)


def test_quality_checks_find_clicks_gaps_and_clipping():
    x = TONE.copy() * 0.2
    x[10_000] += 0.8
    assert Fe.click_points(x, RATE) and not Fe.click_points(TONE * 0.2, RATE)
    x[20_000:22_000] = 0
    assert Fe.gap_runs(x, RATE)[0] == (20_000, 2_000)
    assert Fe.qc(TONE * 2, RATE)["qc.clipping.detected"] == 1.0 and Fe.qc(TONE, RATE)["qc.clipping.detected"] == 0.0
    low = D.cascade(NOISE, D.butterworth(8, 14_000.0, RATE, "low") * 3)
    assert Fe.lossy_origin(low, RATE)["qc.lossy.confidence"] > Fe.lossy_origin(NOISE, RATE)["qc.lossy.confidence"] == 0


def test_short_signals_are_gated_and_clarity_ranks():
    assert set(Fe.movement(TONE[:1000], RATE).values()) == {None} and set(Fe.clarity(TONE[:1000], RATE).values()) == {None}
    muddy, bright = np.sin(2 * np.pi * 300 * T)[:, None], np.sin(2 * np.pi * 3000 * T)[:, None]
    assert Fe.clarity(muddy, RATE)["clarity.mud_presence_ratio"] > Fe.clarity(bright, RATE)["clarity.mud_presence_ratio"]


def test_edits_keep_their_promises():
    two = NOISE
    assert np.allclose(E.stereoize(two, RATE).sum(axis=1), two.sum(axis=1))
    assert np.array_equal(E.reverse(E.reverse(two, RATE), RATE), two)
    assert len(E.stretch(TONE, RATE, 1.5)) == pytest.approx(1.5 * len(TONE), abs=2) and E.pitch(TONE, RATE, 3).shape == TONE.shape
    assert np.abs(E.maximize(two * 5, RATE, ceiling=-1.0)).max() <= 10 ** (-1 / 20) + 1e-9
    assert D.integrated(E.normalize(TONE, RATE, -20.0), RATE) == pytest.approx(-20, abs=0.1)
    assert D.true_peak(E.limit(two * 20, RATE, -3.0))[0] == pytest.approx(-3, abs=0.05)
    assert E.limit(TONE * 0.1, RATE) is not None and np.allclose(E.limit(TONE * 0.1, RATE), TONE * 0.1)
    assert len(E.crop(TONE, RATE, 0.5, 0.75)) == round(0.25 * RATE)
    assert np.array_equal(E.widen(TONE, RATE), TONE)
    assert np.array_equal(
        E.generate("dark", 3),
        E.generate("dark", 3),
    ) and not np.array_equal(E.generate("dark", 3), E.generate("dark", 4))
    assert np.array_equal(E.vocode(TONE, RATE, NOISE), E.vocode(TONE, RATE, NOISE))


def test_describe_isolates_failures(spark):
    rows = [("tone", RATE, 1, len(TONE), [TONE[:, 0].tolist()]), ("silent", RATE, 1, 4096, [[0.0] * 4096])]
    df = spark.createDataFrame(rows, "signal_id string, sr int, ch int, n int, pcm array<array<float>>")
    got = Fe.describe(df, ("loudness", "envelope", "space")).collect()
    assert {(r.signal_id, r.family) for r in got} == {
        (s, f) for s in ("tone", "silent") for f in ("loudness", "envelope", "space")
    }
    assert [r.family for r in got if r.error] == ["envelope"]
    halved = E.edited(df, "gain", db=-6.0).where("signal_id = 'tone'").first()
    assert max(halved.pcm[0]) == pytest.approx(0.5 * 10 ** (-6 / 20), rel=1e-4)
    assert E.edited(df, "stretch", ratio=-1.0).first().error.startswith("op_failed")


def test_wav_table_round_trip(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav.encode(NOISE, RATE, "PCM_24"))
    (tmp_path / "b.wav").write_bytes(b"nothing")
    got = {r.path.rsplit("/", 1)[1]: r for r in wav.read_folder(spark, str(tmp_path)).collect()}
    assert got["a.wav"].n == len(NOISE) and got["b.wav"].error.startswith("decode_failed")


def test_pictures_and_slices(spark):
    from sonorel.operators import images

    clicks = np.zeros(RATE)
    for a in (5000, 20_000, 33_000):
        clicks[a : a + 2000] = np.random.default_rng(a).normal(size=2000) * np.exp(-np.arange(2000) / 300)
    df = spark.createDataFrame(
        [("c", RATE, 1, RATE, [clicks.tolist()]), ("s", RATE, 1, 64, [[0.1] * 64])],
        "signal_id string, sr int, ch int, n int, pcm array<array<float>>",
    )
    got = images.pictures(df, images.PICTURES).collect()
    assert len(got) == 8 and all(bytes(r.png[:8]) == b"\x89PNG\r\n\x1a\n" for r in got)
    found = images.slices(df.where("signal_id = 'c'"), audio=True).orderBy("sample").collect()
    assert len(found) >= 3 and found[0].label == "onset-0"
    assert sum(len(r.pcm[0]) for r in found) == RATE - found[0].sample
