import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import arrays as A
from tessera.operators import payloads as B

R = random.Random(1)
DATA = [b"", b"\0", b"ab", bytes(range(256)), bytes(R.randrange(256) for _ in range(10_000)), None]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, d) for i, d in enumerate(DATA)], "k int, payload binary")


def test_histogram_and_words(df):
    for r in df.select("payload", B.byte_histogram("payload").alias("h"), B.words("payload", 2, pad=True).alias("w")).collect():
        if r["payload"] is None:
            assert r["h"] is None and r["w"] is None
            continue
        d = bytes(r["payload"])
        assert r["h"] == [d.count(bytes([i])) for i in range(256)]
        assert r["w"] == [int.from_bytes(d[i : i + 2], "little") for i in range(0, len(d), 2)]
    with pytest.raises(ValueError):
        B._as_words(b"abc", 2, False)


@pytest.mark.parametrize("width", [1, 2, 4])
def test_delta_round_trip(df, width):
    even = df.filter(f"payload IS NULL OR octet_length(payload) % {width} = 0")
    for r in even.select("payload", B.delta_encode("payload", width).alias("e"), B.delta_decode(B.delta_encode("payload", width), width).alias("b")).collect():
        assert r["b"] == r["payload"]
        if r["payload"]:
            w = np.frombuffer(bytes(r["payload"]), f"<u{width}").astype(object)
            e = np.frombuffer(bytes(r["e"]), f"<u{width}").astype(object)
            m = 1 << 8 * width
            assert e[0] == w[0] and all(e[i] == (w[i] - w[i - 1]) % m for i in range(1, len(w)))


def test_interleave():
    a, b, c, d = b"\x12\x34", b"\x56\x78", b"\x9a\xbc", b"\xde\xf0"
    assert B.interleave_bytes([a, b, c], 8) == b"\x12\x56\x9a\x34\x78\xbc"
    assert B.interleave_bytes([a, b], 16) == B.interleave_bytes([a, b], 15) == b"\x12\x34\x56\x78"
    assert B.interleave_bytes([a, b], 4) == b"\x62\x51\x84\x73"
    assert B.interleave_bytes([a, b, c, d], 4) == b"\x62\xea\x51\xd9\x84\x0c\x73\xfb"
    for bad, bits in (([a, b"\0"], 8), ([a, b, c], 4), ([b"a", b"b"], 16), ([], 8), ([a], 7)):
        with pytest.raises(ValueError):
            B.interleave_bytes(bad, bits)


def test_indices(spark):
    for bits in (1, 2, 4):
        v = [R.randrange(1 << bits) for _ in range(64)]
        assert B.unpack_index_bytes(B.pack_index_bytes(v, bits), bits) == v
    assert B.pack_index_bytes([1, 0, 0, 0, 0, 0, 0, 1], 1) == b"\x81" and B.pack_index_bytes([0] * 8, 1) == b"\0"
    for bad in ([16, 0], [1], [-1, 0]):
        with pytest.raises(ValueError):
            B.pack_index_bytes(bad, 4)
    x = spark.createDataFrame([([3, 1],), (None,)], "v array<int>").select(B.unpack_indices(B.pack_indices("v", 4), 4).alias("v")).collect()
    assert [r["v"] for r in x] == [[3, 1], None]


@pytest.mark.parametrize("fmt", list(B.FORMATS))
@pytest.mark.parametrize("swap", [False, True])
def test_raw_colours(spark, fmt, swap):
    v = np.array([R.randrange(1 << 24) for _ in range(500)] + [0, 0xFFFFFF])
    back = np.array(B.colors_of_bytes(B.color_bytes(v, fmt, swap), fmt, swap))
    assert len(B.color_bytes(v, fmt, swap)) == len(v) * B.FORMATS[fmt]
    if fmt in ("rgb888", "xrgb8888"):
        assert (back == v).all()
    else:  # a second pass changes nothing
        assert (np.array(B.colors_of_bytes(B.color_bytes(back, fmt, swap), fmt, swap)) == back).all() and (np.abs((back & 255) - (v & 255)) <= 5).all()
        from tessera.functions import color as C

        df = spark.createDataFrame([(int(x),) for x in v], "x int").select(C.convert_packed(F.col("x"), "xrgb8888", fmt).alias("w")).collect()
        assert [r["w"] for r in df] == B.pack_colors(v, fmt).tolist()


def test_palette_lookup_and_errors(spark):
    df = spark.createDataFrame([(b"\0\2\1", [7, 8, 9]), (None, [1]), (b"", [])], "p binary, pal array<int>")
    assert [r["c"] for r in df.select(B.indexed_to_colors("p", "pal").alias("c")).collect()] == [[7, 9, 8], None, []]
    with pytest.raises(Exception, match="beyond the palette"):
        spark.createDataFrame([(b"\3", [7, 8, 9])], "p binary, pal array<int>").select(B.indexed_to_colors("p", "pal")).collect()
    with pytest.raises(ValueError):
        B.color_bytes([], "rgb565")
    with pytest.raises(ValueError):
        B.colors_of_bytes(b"abc", "rgb565")


def test_combination(spark):
    assert B.combine_words([b"abcd", b"", b"ef"], 2) == (b"abcdef", [0, 2, 2])
    with pytest.raises(ValueError):
        B.combine_words([b"abc"], 2)
    assert B.combine_maps([[[1, 2], [3]]]) == ([1, 2, 3], [0, 2])
    assert B.combine_maps([[[1, 2], [3]], [[4]]]) == ([1, 2, 3, 4], [0, 3])
    df = spark.createDataFrame([([b"ab", b"cd"], [[[1], [2, 3]]], [[1], [], [2, 3]])], "p array<binary>, m array<array<array<int>>>, q array<array<int>>")
    r = df.select(B.combine("p", 2).alias("c"), B.combine_map_data("m").alias("m"), B.pad_map_data(F.col("q"), 4).alias("q")).first()
    assert bytes(r["c"]["data"]) == b"abcd" and r["c"]["starts"] == [0, 1] and r["m"]["words"] == [1, 2, 3] and r["m"]["starts"] == [0, 1]
    assert r["q"] == [[1, 0, 0, 0], [], [2, 3, 0, 0]]


def test_array_columns(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],), (None,)], "a array<int>")
    got = [r["p"] for r in df.select(A.fill_up_to_multiple(F.col("a"), 4).alias("p")).collect()]
    assert got == [[1, 2, 3, 0], [], None]
    assert [r["p"] for r in df.select(A.divide_by(F.col("a"), 2).alias("p")).collect()] == [[0, 1, 1], [], None]
