import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import color as C
from tessera.operators import arrays as A
from tessera.operators import palette as P
from tessera.operators import tiles as G

# Published test pairs of the CIE 2000 colour difference.
PAIRS = [
    (50, 2.6772, -79.7751, 50, 0, -82.7485, 2.0425), (50, 3.1571, -77.2803, 50, 0, -82.7485, 2.8615), (50, 2.8361, -74.02, 50, 0, -82.7485, 3.4412), (50, -1.3802, -84.2814, 50, 0, -82.7485, 1.0),
    (50, 0, 0, 50, -1, 2, 2.3669), (50, 2.49, -0.001, 50, -2.49, 0.0009, 7.1792), (50, 2.49, -0.001, 50, -2.49, 0.0011, 7.2195), (50, 2.5, 0, 50, 0, -2.5, 4.3065), (50, 2.5, 0, 73, 25, -18, 27.1492),
    (60.2574, -34.0099, 36.2677, 60.4626, -34.1751, 39.4387, 1.2644), (22.7233, 20.0904, -46.694, 23.0331, 14.973, -42.5619, 2.0373), (2.0776, 0.0795, -1.135, 0.9033, -0.0636, -0.5514, 0.9082), (50, 0, 0, 50, 0, 0, 0.0),
]


def test_ciede2000(spark):
    df = spark.createDataFrame([tuple(map(float, p)) for p in PAIRS], "xl double, xa double, xb double, yl double, ya double, yb double, want double")
    for r in C.with_ciede2000(df, "x", "y", "e").collect():
        assert abs(r["e"] - r["want"]) < 1e-4, r


def test_hot_keys_are_split_without_a_change(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", "b", None]), i, r.randrange(1000)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o long, v int").repartition(6)
    for width in (1, 7, 100, 10_000):
        slot = F.floor(F.col("o") / width)
        for f in (A.delta_image, A.delta_image_successive):
            a, b = f(df, ["k"], "o", "v", 16), f(df, ["k"], "o", "v", 16, slot=slot)
            assert sorted((x["o"], x["diff"]) for x in a.collect()) == sorted((x["o"], x["diff"]) for x in b.collect())
        a, b = A.start_indices(df, ["k"], "o", "v"), A.start_indices(df, ["k"], "o", "v", slot=slot)
        assert sorted((x["o"], x["start"]) for x in a.collect()) == sorted((x["o"], x["start"]) for x in b.collect())
    assert A.start_indices(df.limit(0), ["k"], "o", "v", slot=F.col("o")).count() == 0


def _maps(frames, flips, bits, common):
    """Tile maps by a dictionary, tile after tile."""
    out, seen = {}, {}
    for f, tiles in frames.items():
        if not common:
            seen = {}
        n = len({i & ((1 << bits) - 1) for i in seen.values()})
        for p, t in enumerate(tiles):
            g = np.array(t).reshape(8, 8)
            key = lambda x: tuple(x.reshape(-1))
            if key(g) in seen:
                out[f, p] = seen[key(g)]
                continue
            out[f, p] = n
            seen[key(g)] = n
            if flips:
                for k, x in ((1, g[:, ::-1]), (2, g[::-1]), (3, g[::-1, ::-1])):
                    seen[key(x)] = n | k << bits
            n += 1
    return out


@pytest.mark.parametrize("flips,common", list(itertools.product([False, True], [False, True])))
def test_tile_maps(spark, flips, common):
    r = random.Random(2)
    base = [[r.randrange(3) for _ in range(64)] for _ in range(5)] + [[0] * 64, [i % 8 if i % 8 < 4 else 7 - i % 8 for i in range(64)]]
    frames = {}
    for f in range(4):
        frames[f] = []
        for _ in range(30):
            g = np.array(r.choice(base)).reshape(8, 8)
            g = [g, g[:, ::-1], g[::-1], g[::-1, ::-1]][r.randrange(4)]
            frames[f].append([int(x) for x in g.reshape(-1)])
    rows = [(f, p, t) for f, ts in frames.items() for p, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "frame int, pos int, tile array<int>").repartition(5)
    if common:
        got = G.common_tile_map(df, "frame", "pos", "tile", flips)
        tiles = [x["tile"] for x in G.unique_tiles(df.withColumn("at", F.struct("frame", "pos")), "at", "tile", flips).orderBy("tile_id").collect()]
        assert len(tiles) == len({x["tile_id"] for x in got.collect()})
    else:
        got = G.tile_map(df, "pos", "tile", flips, frame="frame")
    assert {(x["frame"], x["pos"]): x["entry"] for x in got.collect()} == _maps(frames, flips, 14 if common else 10, common)


def test_positions(spark):
    """Sprites and tiles by arithmetic are those of reshaped arrays."""
    w, h, sw = 32, 16, 16
    img = np.arange(w * h).reshape(h, w)
    strip = img.reshape(h, w // sw, sw).swapaxes(0, 1).reshape(-1, sw)
    tiles = lambda a: a.reshape(a.shape[0] // 8, 8, a.shape[1] // 8, 8).swapaxes(1, 2).reshape(-1)
    p = F.col("id")
    rows = spark.range(w * h).select("id", G.sprite_position(p, w, h, sw).alias("s"), G.tile_position(p, w).alias("t"), G.sprites_in_tiles(p, w, h, sw).alias("st"), G.block_of(p, w, 8).alias("b")).collect()
    for col, want in (("s", strip.reshape(-1)), ("t", tiles(img)), ("st", tiles(strip))):
        place = {int(v): i for i, v in enumerate(want)}
        assert all(r[col] == place[r["id"]] for r in rows)
    assert all(r["b"] == r["id"] // w // 8 * 4 + r["id"] % w // 8 for r in rows)


def test_too_many_tiles(spark):
    df = spark.range(40).select(F.col("id").alias("pos"), F.array_repeat("id", 64).alias("tile"), F.lit(1).alias("frame"))
    for frame in (None, "frame"):
        assert G.tile_map(df.filter("pos < 32"), "pos", "tile", index_bits=5, frame=frame).count() == 32
        with pytest.raises(Exception, match="too many unique tiles"):
            G.tile_map(df, "pos", "tile", index_bits=5, frame=frame).collect()
    with pytest.raises(ValueError):
        G.crop(df, "pos", 8, 5, 0, 4)


def test_nearest_takes_the_first_of_256(spark):
    r = random.Random(3)
    pal = [r.randrange(1 << 24) for _ in range(254)] + [5, 5]
    cols = [r.randrange(1 << 24) for _ in range(300)] + [5, 0, 0xFFFFFF]
    p = spark.createDataFrame(list(enumerate(pal)), "idx int, xrgb int")
    c = spark.createDataFrame([(x,) for x in cols] + [(None,)], "xrgb int")
    got = {x["xrgb"]: x["idx"] for x in P.nearest(c, p).collect()}

    def dist(a, b):
        ra, rb = (a >> 16) / 255, (b >> 16) / 255
        m = (ra + rb) / 2
        return round(((2 + m) * (ra - rb) ** 2 + 4 * (((a >> 8 & 255) - (b >> 8 & 255)) / 255) ** 2 + (3 - m) * (((a & 255) - (b & 255)) / 255) ** 2) / 9, 9)

    assert got == {x: min(range(256), key=lambda i: (dist(x, pal[i]), i)) for x in set(cols)}
    with pytest.raises(ValueError):
        P.nearest(c, p.unionByName(spark.createDataFrame([(256, 1)], "idx int, xrgb int")))
    with pytest.raises(ValueError):
        P.quantize_closest(c, spark.range(300).select(F.col("id").cast("int").alias("xrgb"), F.col("id").cast("int").alias("target")))


def test_common_palette(spark):
    r = random.Random(4)
    cols = [r.randrange(1 << 24) for _ in range(3000)] + [0x102030] * 500
    df = spark.createDataFrame([(i % 3, x) for i, x in enumerate(cols)], "run long, xrgb int")
    m = {x["xrgb"]: x["target"] for x in P.reduce_common(df, "xrgb", 16).collect()}
    assert set(m) == set(cols) and len(set(m.values())) <= 16
    a, b = P.lab_of(np.array(list(m))), P.lab_of(np.array(list(m.values())))
    pal = P.lab_of(np.array(sorted(set(m.values()))))
    err = P.hyab_matrix(a, pal).min(1)
    assert np.mean(np.diag(P.hyab_matrix(a[:500], b[:500])) <= err[:500] + 1e-9) > 0.9
    few = df.filter("xrgb = 1056816")
    assert [tuple(x) for x in P.reduce_common(few, "xrgb", 16).collect()] == [(0x102030, 0x102030)]
    assert P.reduce_common(df.limit(0), "xrgb", 16).count() == 0


def test_palette_edits(spark):
    df = spark.createDataFrame([([1, 2, 3], [0, 2, 255])], "p array<int>, v array<int>")
    r = df.select(P.add_color0(F.col("p"), 9).alias("a"), P.move_color0(F.col("p"), 3).alias("m"), F.transform("v", lambda v: P.move_index0(v, F.lit(2))).alias("i")).first()
    assert r["a"] == [9, 1, 2, 3] and r["m"] == [3, 2, 1] and r["i"] == [2, 0, 255]
    with pytest.raises(Exception, match="passes 255"):
        df.select(F.transform("v", P.add_index0)).collect()
    with pytest.raises(Exception, match="no such colour"):
        df.select(P.move_color0(F.col("p"), 7)).collect()
    order = P.distance_order([0xFFFFFF, 0x000000, 0x808080, 0x0000FF])
    assert sorted(order) == [0, 1, 2, 3] and order[0] == 1
