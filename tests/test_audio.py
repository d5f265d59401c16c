import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import audio as A


def tone(n, f=0.03, amp=9000):
    return (amp * np.sin(np.arange(n) * f) + 500 * np.sin(np.arange(n) * f * 7.3)).astype(np.int16)


@pytest.mark.parametrize("rates", [(22050, 16000), (8000, 48000), (44100, 44100), (48000, 11025)])
def test_resampling_in_pieces_is_that_of_the_whole(rates):
    x = tone(3000).astype(float)
    whole = A.resample(x, *rates)
    assert len(whole) == -(-3000 * rates[1] // rates[0])
    r, rng, parts, at = A.Resampler(*rates), random.Random(1), [], 0
    while at < len(x):
        n = rng.choice([0, 1, 7, 500])
        parts.append(r.push(x[at : at + n]))
        at += n
    parts.append(r.flush())
    assert np.allclose(np.concatenate(parts), whole, atol=1e-9)
    # a slow tone stays what it is
    mid = slice(len(whole) // 4, len(whole) // 2)
    want = 9000 * np.sin(np.arange(len(whole)) * rates[0] / rates[1] * 0.03) + 500 * np.sin(np.arange(len(whole)) * rates[0] / rates[1] * 0.03 * 7.3)
    assert np.abs(whole - want)[mid].max() < 40


@pytest.mark.parametrize("channels,n", [(1, 1), (1, 2), (1, 1001), (2, 1000), (2, 33)])
def test_adpcm_round_trip(channels, n):
    planes = [tone(n, 0.03 + 0.01 * c) for c in range(channels)]
    back = A.adpcm_decode(A.adpcm_encode(planes))
    assert len(back) == channels and all(len(b) == n and b[0] == p[0] for b, p in zip(back, planes))
    for b, p in zip(back, planes):
        if n > 100:
            noise = ((b.astype(float) - p) ** 2).mean()
            assert 10 * np.log10((p.astype(float) ** 2).mean() / noise) > 25


def test_look_ahead_is_better():
    x = np.cumsum(np.random.default_rng(1).integers(-2000, 2000, (4, 600)), 1).clip(-32000, 32000)

    def error(ahead):
        first, nib = A.adpcm_planes(x, ahead)
        total = 0.0
        for r in range(len(x)):
            v, i = int(x[r, 0]), int(first[r])
            for t, k in enumerate(nib[r], 1):
                v, i = max(-32768, min(32767, v + int(A._DELTA[i, k]))), int(A._NEXT[i, k])
                total += (v - x[r, t]) ** 2.0
        return total

    assert error(3) < error(1)


def test_broken_frames():
    good = A.adpcm_encode([tone(64)])
    for bad in (good[:20], b"\0" * 40):
        with pytest.raises(ValueError):
            A.adpcm_decode(bad)
    for planes in ([], [tone(0)], [tone(4), tone(5)], [tone(4)] * 3, [tone(40_000)]):
        with pytest.raises(ValueError):
            A.adpcm_encode(planes)


def test_layouts(spark):
    assert A.raw_bytes([1, 2, 3, 4], "s16", 2, True) == bytes([1, 0, 3, 0, 2, 0, 4, 0]) and A.raw_bytes([-1], "s8") == b"\xff"
    assert A.samples_of(A.raw_bytes([1, 2, 3, 4], "u16", 2, True), "u16", 2, True).tolist() == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        A.raw_bytes([1, 2, 3], "s16", 2)
    for fmt, x in (("s8", [-128, 0, 127]), ("u8", [0, 128, 255]), ("s16", [-32768, 0, 32767]), ("u16", [0, 32768, 65535]), ("f32", [-1.0, 0.0, 0.5])):
        df = spark.createDataFrame([(v,) for v in x], "v double" if fmt == "f32" else "v int").select(A.to_signed16(F.col("v"), fmt).alias("s")).collect()
        assert [r["s"] for r in df] == A.signed16(np.array(x), fmt).tolist()
        assert np.allclose(A.from_unit(A.to_unit(np.array(x), fmt), fmt), x, atol=1)
    df = spark.createDataFrame([([1, 2, 3, 4],), (None,), ([],)], "x array<int>")
    got = df.select(A.to_raw("x", "s16", 2, True).alias("r"), A.raw_size("x", "s16").alias("n"), A.adpcm("x", 2).alias("a")).collect()
    assert bytes(got[0]["r"]) == bytes([1, 0, 3, 0, 2, 0, 4, 0]) and got[0]["n"] == 8 and got[1]["r"] is None and got[1]["a"] is None and got[2]["a"] is None


def test_sample_buffer():
    b = A.SampleBuffer(2, "u8")
    b.push([1, 2, 3, 11, 12, 13])
    b.push_silence(1)
    assert len(b) == 4 and b.pop(2).tolist() == [1, 2, 11, 12] and b.pop(2).tolist() == [3, 128, 13, 128]
    for bad in (lambda: b.push([1]), lambda: b.pop(1), lambda: A.SampleBuffer(0, "u8"), lambda: A.SampleBuffer(1, "x")):
        with pytest.raises(ValueError):
            bad()


def test_streams(spark):
    r = random.Random(2)
    x = {"a": tone(5000), "b": tone(700)}
    rows = []
    for k, v in x.items():
        at = n = 0
        while at < len(v):
            m = r.choice([10, 300, 777])
            rows.append((k, n, [int(s) for s in v[at : at + m]]))
            at, n = at + m, n + 1
    rows += [("a", 99_999, None), ("c", 0, None), (None, 0, [1])]
    df = spark.createDataFrame(rows, "k string, n int, x array<int>").repartition(4)
    got = {}
    for row in A.resample_frames(df, "k", ["n"], "x", 22050, 16000).orderBy("k", "frame_no").collect():
        got.setdefault(row["k"], []).extend(row["samples"])
    for k in x:
        want = A.from_unit(A.resample(A.to_unit(x[k], "s16"), 22050, 16000), "s16")
        assert (np.array(got[k]) == want).all()
    wins = {}
    for row in A.repackage_frames(df, "k", ["n"], "x", 367.5, 16).orderBy("k", "window_no").collect():
        assert len(row["samples"]) % 16 == 0
        wins.setdefault(row["k"], []).append(row)
    for k in x:
        flat = [s for w in wins[k] for s in w["samples"]]
        assert flat[: len(x[k])] == x[k].tolist() and flat[len(x[k]) :] == [0] * sum(w["padded"] for w in wins[k])
    stereo = A.resample_frames(df, "k", ["n"], "x", 22050, 22050, 1, 2).filter("k = 'b'").orderBy("frame_no").collect()
    assert sum(len(s["samples"]) for s in stereo) == 2 * 700
    assert A.mix_channels(np.array([[1.0, 3.0], [3.0, 5.0]]), 1).tolist() == [[2.0, 4.0]]
