"""Palette operators: histograms, reduction to indices, palette edits.

A palette has at most 256 entries, a bound by definition: it may be broadcast, or handled on the driver. Pixels are rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import color as C

MAX_COLORS = 256


def histogram(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, value, n), counted before the shuffle."""
    return df.groupBy(*keys, value).agg(F.count("*").alias("n"))


def histogram_keep_empty(df: DataFrame, value: str, size: int = 256) -> DataFrame:
    """Counts of all values 0..size-1, zeros too."""
    spark = df.sparkSession
    return spark.range(size).select(F.col("id").cast("int").alias(value)).join(histogram(df, value), value, "left").select(value, F.coalesce("n", F.lit(0)).alias("n"))


def normalize(hist: DataFrame, *keys: str) -> DataFrame:
    """Counts over their sum."""
    total = F.sum("n").over(W.partitionBy(*keys)) if keys else F.sum("n").over(W.partitionBy(F.lit(1)))
    return hist.withColumn("p", F.col("n") / total)


def to_black_white(gray: Column, threshold: float) -> Column:
    """0 below the threshold, 1 from it on; the palette is (black, white)."""
    return F.when(gray < threshold, 0).otherwise(1)


def palette_of(mapping: DataFrame, target: str = "target") -> list[int]:
    """Palette colours of a mapping in their order; more than 256 are an error."""
    few = [r[0] for r in mapping.select(target).distinct().orderBy(target).limit(MAX_COLORS + 1).collect()]
    if len(few) > MAX_COLORS:
        raise ValueError("a palette has at most 256 colours")
    return few


def quantize_closest(pixels: DataFrame, mapping: DataFrame) -> DataFrame:
    """Index of every pixel; ``mapping`` (xrgb, target) sends colours to palette colours, whose indices follow their order. The palette is counted first, and found by position in an array."""
    pal = palette_of(mapping)
    if not pal:
        return pixels.join(mapping.select("xrgb"), "xrgb").withColumn("idx", F.lit(0))
    idx = F.array_position(F.array(*map(F.lit, pal)), F.col("target")).cast("int") - 1
    return pixels.join(mapping.select("xrgb", idx.alias("idx")), "xrgb")


def nearest(colors: DataFrame, pal: DataFrame, value: str = "xrgb") -> DataFrame:
    """(value, idx, dist) of each distinct colour: the first palette entry with the least distance.

    The palette is bounded by 256 entries: it is one array, so that each colour is compared where it stands and no row is multiplied. The distances of an Arrow batch are one matrix.
    """
    rows = pal.select("idx", "xrgb").orderBy("idx").limit(MAX_COLORS + 1).collect()
    if len(rows) > MAX_COLORS:
        raise ValueError("a palette has at most 256 colours")
    idx, p = np.array([r["idx"] for r in rows], np.int64), np.array([r["xrgb"] for r in rows], np.int64)
    b = np.stack([p >> 16 & 255, p >> 8 & 255, p & 255]) / 255.0

    @F.pandas_udf("idx int, dist double")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            v = s.to_numpy(np.int64)
            a = np.stack([v >> 16 & 255, v >> 8 & 255, v & 255]) / 255.0
            r, g, bl = (a[i][:, None] - b[i][None] for i in range(3))
            mean = (a[0][:, None] + b[0][None]) / 2
            d = np.round(((2 + mean) * r * r + 4 * g * g + (3 - mean) * bl * bl) / 9, 9)
            at = d.argmin(1)
            yield pd.DataFrame({"idx": idx[at].astype("int32"), "dist": d[np.arange(len(v)), at]})

    return colors.select(value).filter(F.col(value).isNotNull()).distinct().withColumn("best", best(value)).select(value, F.col("best.idx").alias("idx"), F.col("best.dist").alias("dist"))


def add_color0(palette: Column, color: int) -> Column:
    """Colour in front of a palette of at most 255; pixel indices grow by one."""
    return F.when(F.size(palette) <= 255, F.concat(F.array(F.lit(color)), palette)).otherwise(F.raise_error(F.lit("a palette with 256 colours has no room")))


def add_index0(v: Column) -> Column:
    """Pixel index after ``add_color0``; an error if it would pass 255."""
    return F.when(v < 255, v + 1).otherwise(F.raise_error(F.lit("an index passes 255")))


def move_color0(palette: Column, color: int) -> Column:
    """Palette with the colour swapped to index 0; an error if it isn't there."""
    at = F.array_position(palette, F.lit(color)).cast("int")
    swapped = F.transform(palette, lambda x, i: F.when(i == 0, F.lit(color)).when(i == at - 1, palette[0]).otherwise(x))
    return F.when(at > 0, swapped).otherwise(F.raise_error(F.lit("the palette has no such colour")))


def move_index0(v: Column, at: Column) -> Column:
    """Pixel index after ``move_color0`` has swapped index ``at`` with 0."""
    return F.when(v == 0, at).when(v == at, 0).otherwise(v)


def shift_indices(df: DataFrame, value: str, n: int) -> DataFrame:
    """Indices other than 0 moved by n; an error if one would pass 255."""
    new = F.when(F.col(value) == 0, 0).otherwise(F.col(value) + n)
    return df.withColumn(value, F.when(new <= 255, new).otherwise(F.raise_error(F.lit("an index passes 255"))))


def equalize_palettes(df: DataFrame, palette: str) -> DataFrame:
    """Palettes padded with black to the size of the largest."""
    top = df.agg(F.max(F.size(palette)).alias("top"))  # one row
    return df.crossJoin(F.broadcast(top)).withColumn(palette, F.concat(F.col(palette), F.array_repeat(F.lit(0), F.col("top") - F.size(palette)))).drop("top")


def distance_order(colors: list[int]) -> list[int]:
    """Order of a palette in which neighbours are alike: start with the darkest, then put each colour where it adds the least HyAB distance.

    Ties go to the earlier place and the lower colour. At most 256 colours, on the driver.
    """
    if len(colors) > MAX_COLORS:
        raise ValueError("a palette has at most 256 colours")
    lab = lab_of(np.array(colors))
    d = hyab_matrix(lab, lab)
    todo = sorted(range(len(colors)), key=lambda i: (lab[i][0], colors[i]))
    order: list[int] = []
    for i in todo:
        if len(order) < 2:
            order.append(i)
            continue
        gains = [d[order[0], i]] + [d[order[k], i] + d[i, order[k + 1]] - d[order[k], order[k + 1]] for k in range(len(order) - 1)] + [d[order[-1], i]]
        order.insert(int(np.argmin(np.round(gains, 9))), i)
    return order


# --- reduction ---------------------------------------------------------------------------------------------------------


def lab_of(xrgb: np.ndarray) -> np.ndarray:
    """L*a*b* of packed colours, linearised first."""
    return _lab(np.stack([xrgb >> 16 & 255, xrgb >> 8 & 255, xrgb & 255], -1) / 255.0)


def hyab_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    dl = np.abs(a[:, None, 0] - b[None, :, 0]) / 100
    return (np.sqrt((((a[:, None, 1:] - b[None, :, 1:]) / 255) ** 2).sum(-1)) + dl) / 2.414213562


def maximin_seeds(lab: np.ndarray, n: int) -> np.ndarray:
    """The colour nearest to the middle of the bounding box, then always the one that is farthest from its nearest seed."""
    mid = (lab.min(0) + lab.max(0)) / 2
    seeds = [int(np.argmin(hyab_matrix(lab, mid[None])[:, 0]))]
    near = hyab_matrix(lab, lab[seeds])[:, 0]
    while len(seeds) < n:
        seeds.append(int(np.argmax(near)))
        near = np.minimum(near, hyab_matrix(lab, lab[seeds[-1:]])[:, 0])
    return lab[seeds]


def online_kmeans(lab: np.ndarray, weight: np.ndarray, centers: np.ndarray, passes: int = 2) -> np.ndarray:
    """Centres drawn to one colour after the other with rate weight^-0.5; a full-cycle generator gives the order."""
    c = centers.copy()
    seen = np.ones(len(c))
    n = len(lab)
    size = 1 << max(2, int(n - 1).bit_length())
    for _ in range(passes):
        x = 1
        for _ in range(size):
            x = (x * 5 + 3) % size  # odd addend and a multiplier of 1 mod 4: every number comes once
            if x >= n:
                continue
            k = int(np.argmin(hyab_matrix(lab[x : x + 1], c)[0]))
            seen[k] += weight[x]
            c[k] += (lab[x] - c[k]) * (weight[x] / seen[k]) ** 0.5
    return c


def reduce_colors(colors: np.ndarray, counts: np.ndarray, n: int, grid: str = "xrgb1555") -> np.ndarray:
    """Palette colour of each distinct colour: at most n, on the grid of the target format.

    As many colours as fit are kept as they are, not snapped. Otherwise: seeds by maximin, online k-means in L*a*b*, assignment to the first nearest centre, weighted means, and
    snapping of the centres to the grid, black included; equal centres merge.
    """
    if len(colors) <= n:
        return colors
    lab = lab_of(colors)
    centers = online_kmeans(lab, counts.astype(float), maximin_seeds(lab, n))
    rgb = np.stack([colors >> 16 & 255, colors >> 8 & 255, colors & 255], -1).astype(float)
    snapped = np.zeros(len(centers), np.int64)
    for _ in range(3):
        own = np.argmin(hyab_matrix(lab, centers), 1)
        for k in range(len(centers)):
            m = own == k
            if m.any():
                mean = (rgb[m] * counts[m, None]).sum(0) / counts[m].sum()
                snapped[k] = _snap(mean, grid)
                centers[k] = lab_of(snapped[k : k + 1])[0]
    pal = np.unique(snapped[np.unique(own)])
    return pal[np.argmin(hyab_matrix(lab, lab_of(pal)), 1)]


def _snap(rgb: np.ndarray, grid: str) -> int:
    top = {"xrgb1555": (31, 31, 31), "rgb565": (31, 63, 31), "xrgb8888": (255, 255, 255)}[grid]
    out = 0
    for x, t in zip(rgb, top):
        out = out << 8 | int(np.floor(np.floor(x / 255 * t + 0.5) * 255 / t + 0.5))
    return out


def reduce_frames(df: DataFrame, key: str, value: str, n: int, grid: str = "xrgb1555") -> DataFrame:
    """(key, value, target) for the distinct colours of every frame. The histogram is made before; a group holds a frame's distinct colours."""
    hist = histogram(df, value, key)

    def run(k, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(value, ignore_index=True)
        t = reduce_colors(pdf[value].to_numpy(np.int64), pdf["n"].to_numpy(), n, grid)
        return pd.DataFrame({key: pdf[key], value: pdf[value], "target": t.astype("int32")})

    return hist.groupBy(key).applyInPandas(run, f"{key} long, {value} int, target int")


def common_palette(hist: DataFrame, value: str, n: int, grid: str = "xrgb1555", rounds: int = 2) -> list[int]:
    """At most n colours, in ascending order, for all colours of a histogram (value, n), however many there are.

    All colours count: they are summed up by cells of five bits a channel, of which there are at most 32768, and the means of the cells, weighted with their pixels, give the centres. Then each distinct colour goes
    to its nearest centre, and centres move to the weighted means of their colours, in ``rounds`` passes over the distinct colours that only bring sums to the driver. As many colours as fit are kept as they are.
    """
    spark = hist.sparkSession
    ch = [F.shiftright(value, s).bitwiseAND(F.lit(255)) for s in (16, 8, 0)]
    cell = F.expr(f"shiftright({value} & 16252928, 9) + shiftright({value} & 63488, 6) + shiftright({value} & 248, 3)")
    cells = hist.groupBy(cell.alias("cell")).agg(F.count("*").alias("k"), F.sum("n").alias("n"), *(F.sum(c * F.col("n")).alias(x) for c, x in zip(ch, "rgb"))).orderBy("cell").toPandas()
    if cells["k"].sum() <= n:
        return sorted(r[0] for r in hist.select(value).collect())
    w = cells["n"].to_numpy(float)
    mean = cells[["r", "g", "b"]].to_numpy(float) / w[:, None]
    centers = online_kmeans(_lab(mean / 255), w, maximin_seeds(_lab(mean / 255), min(n, len(w))))
    snapped: list[int] = []
    for _ in range(max(1, rounds)):
        own = nearest_center(spark, centers)
        sums = hist.withColumn("_k", own(value)).groupBy("_k").agg(F.sum("n").alias("n"), *(F.sum(c * F.col("n")).alias(x) for c, x in zip(ch, "rgb"))).orderBy("_k").toPandas()  # one row for each centre
        snapped = [_snap(np.array(rgb, float) / count, grid) for _, count, *rgb in sums.itertuples(index=False)]
        centers = lab_of(np.array(snapped))
    return sorted(set(snapped))


def nearest_center(spark: SparkSession, centers: np.ndarray):
    """Column function: number of the first centre nearest to a packed colour in L*a*b*."""
    shared = spark.sparkContext.broadcast(centers)  # at most 256 rows

    @F.pandas_udf("int")
    def own(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(np.argmin(hyab_matrix(lab_of(s.to_numpy(np.int64)), shared.value), 1).astype("int32"))

    return own


def reduce_common(df: DataFrame, value: str, n: int, grid: str = "xrgb1555", rounds: int = 2) -> DataFrame:
    """(value, target): one palette for the colours of all rows, see ``common_palette``."""
    hist = histogram(df.filter(F.col(value).isNotNull()), value)
    pal = common_palette(hist, value, n, grid, rounds)
    if not pal:
        return hist.select(value, F.col(value).alias("target"))
    return hist.select(value, F.element_at(F.array(*map(F.lit, pal)), nearest_center(df.sparkSession, lab_of(np.array(pal)))(value) + 1).alias("target"))


def _lab(rgb: np.ndarray) -> np.ndarray:
    """L*a*b* of channels in 0..1, linearised first."""
    lin = np.where(rgb <= 0.04045, rgb / 12.92, ((rgb + 0.055) / 1.055) ** 2.4)
    xyz = lin @ np.array(C.RGB_TO_XYZ).T / np.array(C.WHITE)
    f = np.where(xyz > C.EPSILON, np.cbrt(xyz), (C.KAPPA * xyz + 16) / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)
