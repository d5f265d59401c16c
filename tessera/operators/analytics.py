"""Statistics of signals and colours: bounding boxes, correlation, transforms, scaled counts, fade tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bounding_box(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Least and largest of each value, and the length of the diagonal."""
    box = df.groupBy(*keys).agg(*(f(v).alias(f"{n}_{v}") for v in values for n, f in (("min", F.min), ("max", F.max))))
    size = sum(((F.col(f"max_{v}") - F.col(f"min_{v}")) * (F.col(f"max_{v}") - F.col(f"min_{v}")) for v in values), F.lit(0))
    return box.withColumn("diagonal", F.sqrt(size))


def dct2(df: DataFrame, keys: list[str], pos: str, value: str, n: int = 8) -> DataFrame:
    """Unnormalised two-dimensional DCT-II of n x n blocks: (keys, u, v, coefficient).

    The separable transform is done along rows, then along columns: each step multiplies with a basis of n values per row, not n^2. The basis is an array literal.
    """
    basis = lambda u: F.array(*(F.lit(math.cos(math.pi / n * (i + 0.5) * u)) for i in range(n)))
    x, y = F.col(pos) % n, F.floor(F.col(pos) / n).cast("int")
    v = F.col(value)
    rows = df.groupBy(*keys, y.alias("_y")).agg(*(F.sum(v * basis(u)[x]).alias(f"_u{u}") for u in range(n)))
    cols = rows.groupBy(*keys).agg(*(F.sum(F.col(f"_u{u}") * basis(w)[F.col("_y")]).alias(f"_c{w}_{u}") for w in range(n) for u in range(n)))
    flat = F.array(*(F.struct(F.lit(u).alias("u"), F.lit(w).alias("v"), F.col(f"_c{w}_{u}").alias("coefficient")) for w in range(n) for u in range(n)))
    return cols.select(*keys, F.inline(flat))


def counters(df: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """(keys, index, value): sums of values by key and index; indices from 0 to the largest of a key that were never counted are 0.0. Null and negative indices are left out."""
    sums = df.filter(F.col(index) >= 0).groupBy(*keys, F.col(index).cast("int").alias(index)).agg(F.sum(F.col(value).cast("double")).alias(value))
    every = sums.groupBy(*keys).agg(F.max(index).alias("_top")).select(*keys, F.explode(F.sequence(F.lit(0), F.col("_top"))).alias(index))
    return every.join(sums, [*keys, index], "left").select(*keys, index, F.coalesce(value, F.lit(0.0)).alias(value))


def convolution0(a: Column, b: Column) -> Column:
    """Convolution at shift zero."""
    return F.sum(a * b)


def scaled_counts(hist: DataFrame, keys: list[str], symbol: str, n: str, total_bits: int = 14) -> DataFrame:
    """Counts of each key's symbols scaled to a sum of 2^total_bits, each at least 1: (keys, symbol, c).

    Rounded counts are mended by one unit at a time, round robin in order of their fractions (ties: the lower symbol), which is a rank over units: unit u of the symbol with
    rank r comes before all units u + 1. A key has at most 256 symbols.
    """
    m = 1 << total_bits
    wk = W.partitionBy(*keys)
    exact = F.col(n) * float(m) / F.sum(n).over(wk)
    h = hist.withColumn("_f", exact).withColumn("_c", F.greatest(F.lit(1), F.least(F.lit(m - 1), F.floor(F.col("_f") + 0.5)))).withColumn("_fr", F.round(F.col("_f") - F.floor("_f"), 9))
    h = h.withColumn("_d", F.lit(m) - F.sum("_c").over(wk))
    h = h.withColumn("_r", F.row_number().over(wk.orderBy(F.when(F.col("_d") > 0, -F.col("_fr")).otherwise(F.col("_fr")), symbol)))
    room = F.when(F.col("_d") > 0, F.lit(m - 1) - F.col("_c")).otherwise(F.col("_c") - 1)
    units = F.least(room, F.abs("_d")).cast("int")
    u = h.filter("_d <> 0").select(*keys, symbol, "_r", "_d", F.explode(F.when(units > 0, F.sequence(F.lit(1), units))).alias("_u"))
    taken = u.withColumn("_o", F.row_number().over(wk.orderBy("_u", "_r"))).filter("_o <= abs(_d)").groupBy(*keys, symbol).agg((F.count("*") * F.max(F.signum("_d"))).alias("_m"))
    return h.join(taken, [*keys, symbol], "left").select(*keys, symbol, (F.col("_c") + F.coalesce("_m", F.lit(0))).cast("long").alias("c"))


def fade(r0: Column, r1: Column, amount: float) -> Column:
    """Channel of a colour that fades into another: rounded mix."""
    return F.floor(r0 * (1.0 - amount) + r1 * amount + 0.5).cast("int")


def fade_table(palette: DataFrame, amount: float) -> DataFrame:
    """(i, j, idx): for each pair of palette entries, the first entry nearest to the mix of their colours. At most 256 entries.

    Only the last step of a fade table, over the given colours and with a linear mix; ``fade_index_map`` is the whole.
    """
    from tessera.functions import color as C
    from tessera.operators.palette import nearest

    p = F.broadcast(palette.select("idx", "xrgb"))  # ``nearest`` refuses more than 256 entries
    a, b = p.select(F.col("idx").alias("i"), F.col("xrgb").alias("x")), p.select(F.col("idx").alias("j"), F.col("xrgb").alias("y"))
    mixed = a.crossJoin(b).select("i", "j", C.pack(tuple(fade(c, e, amount) for c, e in zip(C.channels(F.col("x")), C.channels(F.col("y"))))).alias("mix"))
    return mixed.join(nearest(mixed, palette, "mix"), "mix").select("i", "j", "idx")


def fade_mix(c0: np.ndarray, c1: np.ndarray, amount: int, fmt: str = "xrgb1555", swap: bool = False) -> np.ndarray:
    """First colour faded by ``amount`` steps of the format, then averaged with the second on its grid; ``swap`` swaps red and blue of the result."""
    out = []
    for at, bits in zip((16, 8, 0), (3, 2 if fmt == "rgb565" else 3, 3)):
        a = np.maximum((c0 >> at & 255) - (amount << bits), 0)
        out.append((2 * a + 2 * (c1 >> at & 255) + 1) >> 2 + bits << bits)
    r, g, b = out[::-1] if swap else out
    return r << 16 | g << 8 | b


def fade_closure(colors: list[int], amount: int, fmt: str = "xrgb1555", swap: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All colours that fading and mixing makes from the given ones, in ascending order, and how often each comes.

    Colours are taken from a queue; each is mixed with itself and all taken before it, and mixes that are new join the queue, until it is empty. New colours lie on the grid of the
    format, so there are at most 32,768 (65,536 for rgb565) besides the given ones: the work is bounded and done on the driver.
    """
    places = ((16, 3, 11 if fmt == "rgb565" else 10), (8, 2 if fmt == "rgb565" else 3, 5), (0, 3, 0))  # shift in a colour, bits off the grid, shift in a word of the format
    size = 1 << (16 if fmt == "rgb565" else 15)
    word = np.arange(size)
    color = sum((word >> w & (255 >> bits)) << bits << at for at, bits, w in places)  # of each word
    given = np.isin(color, colors)
    known, taken = given.copy(), np.zeros(size, bool)  # known: taken, or in the queue
    count = np.zeros(size, np.int64)
    level = np.arange(256)
    order = np.empty(0, np.int64)  # colours taken, ascending, and their channels
    parts = [np.empty(0, np.uint8)] * 3
    queue, seen, at = list(colors), set(), 0
    to_word = {int(x): int(i) for i, x in enumerate(color)}
    while at < len(queue):
        c = queue[at]
        at += 1
        if c not in seen:
            seen.add(c)
            k = int(np.searchsorted(order, c))
            order = np.insert(order, k, c)
            parts = [np.insert(x, k, c >> p[0] & 255) for x, p in zip(parts, places)]
            if c in to_word and not given[to_word[c]]:
                taken[to_word[c]] = True
                count[to_word[c]] = 1
        tables = []
        for (shift, bits, _), (_, _, w) in zip(places, places[::-1] if swap else places):
            tables.append((fade_mix(np.int64((c >> shift & 255) << shift), level << shift, amount, fmt) >> shift + bits & 255) << w)
        mixes = tables[0][parts[0]] | tables[1][parts[1]] | tables[2][parts[2]]
        count += np.bincount(mixes, minlength=size) * taken
        fresh = mixes[~known[mixes]]
        if len(fresh):
            fresh = fresh[np.sort(np.unique(fresh, return_index=True)[1])]
            known[fresh] = True
            queue += color[fresh].tolist()
    return order, np.array([count[to_word[c]] if c in to_word and not given[to_word[c]] else 1 for c in order.tolist()], np.int64)


def fade_palette(colors: list[int], amount: int, size: int = 256, fmt: str = "xrgb1555", swap: bool = False) -> list[int]:
    """The given colours, and behind them those of the closure reduced to the rest of ``size``."""
    from tessera.operators.palette import reduce_colors

    if not 0 < len(colors) <= size <= 256:
        raise ValueError("a palette has at most 256 colours")
    if len(colors) == size:
        return list(colors)
    all_colors, counts = fade_closure(colors, amount, fmt, swap)
    return [*colors, *np.unique(reduce_colors(all_colors, counts, size - len(colors), fmt)).tolist()]


def fade_index_map(palette: DataFrame, amount: int, size: int = 256, fmt: str = "xrgb1555", swap: bool = False) -> DataFrame:
    """(pair, idx, xrgb) of all 65,536 pairs ``i0 << 8 | i1``: the first entry nearest to the fade of the two, and its colour; 0 where an entry doesn't exist.

    The palette is closed under fading and mixing and reduced to ``size`` colours before.
    """
    from tessera.functions import color as C

    rows = palette.select("idx", "xrgb").orderBy("idx").limit(size + 1).collect()
    colors = fade_palette([r["xrgb"] for r in rows], amount, size, fmt, swap)
    spark = palette.sparkSession
    full = F.broadcast(spark.createDataFrame(list(enumerate(colors)), "idx int, xrgb int"))  # at most 256 rows
    a = np.array(colors, np.int64)
    n = len(a)
    mixes = fade_mix(np.repeat(a, n), np.tile(a, n), amount, fmt, swap)
    pairs = spark.createDataFrame([((k // n) << 8 | k % n, m) for k, m in enumerate(mixes.tolist())], "pair int, mix int")
    d = F.round(C.mse_rgb(C.to_rgbf(F.col("mix")), C.to_rgbf(F.col("xrgb"))), 9)
    best = pairs.select("mix").distinct().crossJoin(full).groupBy("mix").agg(F.min(F.struct(d.alias("d"), "idx", "xrgb")).alias("best"))
    found = pairs.join(best, "mix").select("pair", "best.idx", "best.xrgb")
    every = spark.range(1 << 16).select(F.col("id").cast("int").alias("pair"))
    return every.join(found, "pair", "left").select("pair", F.coalesce("idx", F.lit(0)).alias("idx"), F.coalesce("xrgb", F.lit(colors[0])).alias("xrgb"))
