"""Tiles, sprites and blocks: positions by arithmetic, tile maps by first occurrence.

Pixels are rows (key, pos, v) in scan-line order, tiles are arrays of 64 values in tile order. Tile maps compare the pixels themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sprite_position(pos: Column, width: int, height: int, sprite_width: int) -> Column:
    """Place of a pixel when the image is cut into columns ``sprite_width`` wide that are put below each other."""
    x, y = pos % width, F.floor(pos / width)
    return (F.floor(x / sprite_width) * height + y) * sprite_width + x % sprite_width


def tile_position(pos: Column, width: int, tile_width: int = 8, tile_height: int = 8) -> Column:
    """Place of a pixel when tiles follow each other row by row."""
    x, y = pos % width, F.floor(pos / width)
    tile = F.floor(y / tile_height) * (width // tile_width) + F.floor(x / tile_width)
    return tile * (tile_width * tile_height) + (y % tile_height) * tile_width + x % tile_width


def sprites_in_tiles(pos: Column, width: int, height: int, sprite_width: int) -> Column:
    """Sprite order, then tile order within the strip of sprites."""
    return tile_position(sprite_position(pos, width, height, sprite_width), sprite_width)


def block_of(pos: Column, width: int, size: int) -> Column:
    """Row-major number of the ``size`` x ``size`` block that holds a pixel."""
    return F.floor(F.floor(pos / width) / size) * (width // size) + F.floor((pos % width) / size)


def crop(df: DataFrame, pos: str, width: int, x: int, y: int, size: int, height: int | None = None) -> DataFrame:
    """Pixels of the block at (x, y), with positions inside it; a block that reaches beyond the image is an error."""
    if x < 0 or y < 0 or x + size > width or height is not None and y + size > height:
        raise ValueError("the block reaches beyond the image")
    px, py = F.col(pos) % width, F.floor(F.col(pos) / width)
    inside = df.filter((px >= x) & (px < x + size) & (py >= y) & (py < y + size))
    return inside.withColumn(pos, (py - y) * size + (px - x))


_FLIPS = {"n": "i", "h": "(i div 8) * 8 + 7 - i % 8", "v": "(7 - i div 8) * 8 + i % 8", "hv": "63 - i"}


def flipped(tile: str, how: str) -> Column:
    """Tile of 8 x 8 flipped by none (n), columns (h), rows (v) or both (hv)."""
    return F.expr(f"transform(sequence(0, 63), i -> {tile}[cast({_FLIPS[how]} as int)])")


def tile_map(df: DataFrame, order: str, tile: str, flips: bool = False, index_bits: int = 10, frame: str | None = None) -> DataFrame:
    """Screen maps: ([frame,] order, tile_id, entry) where entry has the tile's number in its low bits and, with ``flips``, the flip bits above them.

    Tiles are numbered by first occurrence: over all rows, or within each ``frame``. Equal tiles meet by grouping, without a hash of our own; the distinct tiles are at most 2^index_bits by definition of a
    screen map, more are an error, which is seen before anything is sorted in one task. A repeat of a symmetric tile carries the bits of the last of none, h, v, hv that fits, its first occurrence none.
    """
    keys = [frame] if frame else []
    if flips:
        df = df.withColumns({f"_{k}": flipped(tile, k) for k in ("h", "v", "hv")}).withColumn("_key", F.least(tile, "_h", "_v", "_hv"))
    else:
        df = df.withColumn("_key", F.col(tile))
    first = df.groupBy(*keys, "_key").agg(F.min(F.struct(F.col(order).alias("p"), F.col(tile).alias("t"))).alias("f"))
    limit = 1 << index_bits
    if frame:
        w = W.partitionBy(frame).orderBy("f.p")
        ranked = first.withColumn("tile_id", F.row_number().over(w) - 1)
    else:
        few = first.orderBy("f.p").limit(limit + 1)  # a bounded number of rows, kept by each task before they meet
        ranked = few.withColumn("tile_id", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("f.p")) - 1)
    ids = ranked.withColumn("tile_id", F.when(F.col("tile_id") < limit, F.col("tile_id")).otherwise(F.raise_error(F.lit("too many unique tiles"))))
    ids = ids.select(*keys, "_key", F.col("f.p").alias("_p"), F.col("f.t").alias("_t"), "tile_id")
    j = df.join(ids, [*keys, "_key"])
    if not flips:
        return j.select(*keys, order, "tile_id", F.col("tile_id").alias("entry"))
    same = lambda k: F.col("_t") == F.col(f"_{k}")
    bits = F.when(F.col(order) == F.col("_p"), 0).when(same("hv"), 3).when(same("v"), 2).when(same("h"), 1).otherwise(0)
    return j.select(*keys, order, "tile_id", (F.col("tile_id") + bits * limit).alias("entry"))


def common_tile_map(df: DataFrame, frame: str, pos: str, tile: str, flips: bool = False, index_bits: int = 14) -> DataFrame:
    """Screen maps of several frames over one set of tiles, numbered by first occurrence in order of (frame, pos): (frame, pos, tile_id, entry)."""
    m = tile_map(df.withColumn("_at", F.struct(frame, pos)), "_at", tile, flips, index_bits)
    return m.select(F.col(f"_at.{frame}").alias(frame), F.col(f"_at.{pos}").alias(pos), "tile_id", "entry")


def unique_tiles(df: DataFrame, order: str, tile: str, flips: bool = False) -> DataFrame:
    """(tile_id, tile): the tiles that a map refers to, each as it first occurs. The pixels of a reduced image, whose palette is that of the first frame."""
    key = F.least(tile, *(flipped(tile, k) for k in ("h", "v", "hv"))) if flips else F.col(tile)
    first = df.withColumn("_key", key).groupBy("_key").agg(F.min(F.struct(F.col(order).alias("p"), F.col(tile).alias("t"))).alias("f"))
    few = first.orderBy("f.p").limit((1 << 14) + 1)
    ranked = few.withColumn("tile_id", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("f.p")) - 1)
    return ranked.select(F.when(F.col("tile_id") < 1 << 14, F.col("tile_id")).otherwise(F.raise_error(F.lit("too many unique tiles"))).alias("tile_id"), F.col("f.t").alias("tile"))


def block_mse(df: DataFrame, keys: list[str], pos: str, a: str, b: str, width: int, size: int) -> DataFrame:
    """(keys, block, mse): mean distance of two packed colours over each ``size`` x ``size`` block."""
    from tessera.functions import color as C

    d = C.mse_rgb(C.to_rgbf(F.col(a)), C.to_rgbf(F.col(b)))
    return df.groupBy(*keys, block_of(F.col(pos), width, size).cast("int").alias("block")).agg(F.avg(d).alias("mse"))
