"""Sinks and sources of files: C source text, binary blobs with offsets, WAV, PNG, CSV, images, decoded video frames, metadata."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.audio import raw_bytes, signed16, wav_header
from tessera.operators.payloads import byte_histogram, mapped


def c_array(name: str, values: Column, per_line: int = 10, kind: str = "uint8_t", digits: int = 2) -> Column:
    """C definition of an array column, ``per_line`` hex values on a line."""
    hexes = F.transform(values, lambda v: F.concat(F.lit("0x"), F.lpad(F.hex(v), digits, "0")))
    n = F.size(values)
    lines = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / per_line).cast("int"))), lambda i: F.array_join(F.slice(hexes, i * per_line + 1, per_line), ", "))
    return F.concat(F.lit(f"_Alignas(4) const {kind} {name}["), n.cast("string"), F.lit("] = {\n    "), F.array_join(lines, ",\n    "), F.lit("\n};\n"))


def c_defines(prefix: str, **values: Column) -> Column:
    """Lines ``#define PREFIX_NAME value``."""
    return F.concat(*(F.concat(F.lit(f"#define {prefix.upper()}_{k.upper()} "), v.cast("string"), F.lit("\n")) for k, v in values.items()))


def with_offsets(df: DataFrame, keys: list[str], order: str, payload: str, unit: int = 1) -> DataFrame:
    """Start of each payload, in units of ``unit`` bytes, when the payloads of a key are put behind each other; sizes must be multiples of the unit."""
    size = F.octet_length(payload)
    ok = F.when(size % unit == 0, size / unit).otherwise(F.raise_error(F.lit("a size is no multiple of the unit")))
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("start", F.coalesce(F.sum(ok).over(w), F.lit(0)).cast("long"))


def wav_bytes(samples, channels: int, rate: int, fmt: str = "s16") -> bytes:
    """WAV file of planar samples: 8 bits are stored unsigned, 16 bits signed, floats as 16 bits."""
    x = np.asarray(samples)
    if fmt == "s8":
        x, kind = x.astype(np.int64) + 128, "u8"
    elif fmt == "u8":
        kind = "u8"
    else:
        x, kind = signed16(x, fmt), "s16"
    body = raw_bytes(x, kind, channels, interleave=True)
    return wav_header(channels, rate, 8 if kind == "u8" else 16, len(body)) + body


def wav(samples: Column, channels: Column, rate: Column, fmt: str = "s16") -> Column:
    """WAV file of an array of planar samples."""
    return mapped(lambda s, c, r: wav_bytes(s, int(c), int(r), fmt), T.BinaryType(), samples, channels, rate)


def png_bytes(xrgb: np.ndarray, width: int, height: int) -> bytes:
    """PNG file of packed colours."""
    xrgb = np.asarray(xrgb)
    if len(xrgb) != width * height:
        raise ValueError(f"{len(xrgb)} pixels for {width} x {height}")
    img = xrgb.reshape(height, width)
    rows = np.zeros((height, 1 + 3 * width), np.uint8)
    rows[:, 1:] = np.stack([img >> 16 & 255, img >> 8 & 255, img & 255], -1).astype(np.uint8).reshape(height, -1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def color_map_png(fmt: str) -> bytes:
    """PNG file of all colours of 5-5-5 (256 x 128) or 5-6-5 (256 x 256), in order of their words."""
    word = np.arange(1 << (16 if fmt == "rgb565" else 15))
    r, g, b = (word >> 11 & 31, word >> 5 & 63, word & 31) if fmt == "rgb565" else (word >> 10 & 31, word >> 5 & 31, word & 31)
    return png_bytes(255 * r // 31 << 16 | 255 * g // (63 if fmt == "rgb565" else 31) << 8 | 255 * b // 31, 256, len(word) // 256)


def write_file(path: str, data: bytes) -> None:
    """Write a file on any file system that the path names: it is written beside its place and then moved there, so that no reader sees a part of it."""
    import uuid

    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    parent = at.rsplit("/", 1)[0]
    system.create_dir(parent, recursive=True)
    beside = f"{at}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(beside) as f:
        f.write(data)
    system.move(beside, at)


def write_files(df: DataFrame, path: str, name: str, payload: str) -> int:
    """One file for each row, named by a column, written by the tasks; the number of files. Names must be unique."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = 0
            for file, data in zip(pdf[name], pdf[payload]):
                if file is not None and data is not None:
                    write_file(f"{path}/{file}", bytes(data))
                    n += 1
            yield pd.DataFrame({"n": [n]})

    return df.select(name, payload).mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_blobs(frames: DataFrame, path: str, name: str) -> int:
    """Binary files of frames: pixels as ``<name>``, screen maps as ``<name>_map`` and palettes as ``<name>_pal``, where there are any."""
    words = mapped(lambda maps: np.concatenate([np.asarray(m, "<u2") for m in maps]).tobytes() if len(maps) else b"", T.BinaryType(), "maps")
    parts = F.array(
        F.struct(F.col(name).alias("file"), F.col("payload").alias("data")), F.struct(F.concat(name, F.lit("_map")).alias("file"), words.alias("data")), F.struct(F.concat(name, F.lit("_pal")).alias("file"), F.col("palette_raw").alias("data"))
    )
    files = frames.select(F.explode(parts).alias("f")).select("f.file", "f.data").filter("data IS NOT NULL AND octet_length(data) > 0")
    return write_files(files, path, "file", "data")


def byte_statistics_rows(df: DataFrame, keys: list[str], payload: str, original_size: str | None = None) -> DataFrame:
    """Statistics of payloads: shares of the 256 byte values, size of the alphabet, entropy in bits, and the size in per cent of ``original_size``."""
    h = df.withColumn("_h", byte_histogram(payload)).withColumn("_n", F.octet_length(payload))
    p = F.transform("_h", lambda n: F.when(F.col("_n") > 0, n / F.col("_n")).otherwise(0.0))
    h = h.withColumn("_p", p)
    entropy = F.aggregate(F.filter("_p", lambda x: x > 0), F.lit(0.0), lambda a, x: a - x * F.log2(x))
    ratio = F.col("_n") * 100.0 / F.col(original_size) if original_size else F.lit(None).cast("double")
    return h.select(*keys, F.col("_p").alias("shares"), F.size(F.filter("_h", lambda n: n > 0)).alias("alphabet"), entropy.alias("entropy"), ratio.alias("ratio"))


def write_statistics_csv(stats: DataFrame, keys: list[str], path: str) -> None:
    """CSV files of ``byte_statistics_rows``: keys, 256 shares, alphabet, entropy, ratio."""
    stats.select(*keys, *(F.col("shares")[i].alias(f"b{i}") for i in range(256)), "alphabet", "entropy", "ratio").write.mode("overwrite").option("header", True).csv(path)


def write_clusters_csv(clusters: DataFrame, path: str) -> None:
    """CSV files of fitted colours: colour, its hex form, the number of its cluster and the cluster's colour in hex. ``clusters`` has xrgb, clusterindex, clustercolor."""
    from tessera.functions import color as C

    r, g, b = C.channels(F.col("xrgb"), "xrgb8888")
    hexed = lambda c: F.concat(F.lit("#"), C.to_hex(F.col(c)))
    clusters.select(r.alias("r"), g.alias("g"), b.alias("b"), hexed("xrgb").alias("csscolor"), "clusterindex", hexed("clustercolor").alias("clustercolor")).write.mode("overwrite").option("header", True).csv(path)


def statistics_images(frames: DataFrame, name: str) -> DataFrame:
    """(stream, frame_no, id, png): frames as pictures beside the statistics of their stream."""
    from tessera.plans.image_steps import colors
    from tessera.plans.frames import Frame

    def picture(width, height, fmt, palette, payload) -> bytes:
        f = Frame(int(width), int(height), fmt, [int(c) for c in palette], None, None, bytes(payload))
        return png_bytes(colors(f), f.width, f.height)

    pal = F.coalesce("palette", F.array().cast("array<int>"))
    return frames.select("stream", "frame_no", F.lit(name).alias("id"), mapped(picture, T.BinaryType(), "width", "height", "format", pal, "payload").alias("png"))


def read_images(spark, path: str) -> DataFrame:
    """(path, width, height, format, palette, payload) of image files, decoded in the JVM: gray ones as indices into a palette of 256 grays, others as 24-bit colours with four bytes each."""
    i = spark.read.format("image").load(path).select("image.*").filter("width > 0 AND height > 0")

    def pixels(data, channels) -> bytes:
        x = np.frombuffer(bytes(data), np.uint8).reshape(-1, int(channels))
        if x.shape[1] == 1:
            return x.tobytes()
        out = np.zeros((len(x), 4), np.uint8)
        out[:, :3] = x[:, :3]  # blue, green, red
        return out.tobytes()

    gray = F.col("nChannels") == 1
    grays = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: v * 65793)
    return i.select(
        F.col("origin").alias("path"), "width", "height", F.when(gray, "paletted8").otherwise("xrgb8888").alias("format"), F.when(gray, grays).alias("palette"), mapped(pixels, T.BinaryType(), "data", "nChannels").alias("payload")
    )


def read_video_frames(spark, path: str) -> DataFrame:
    """(stream, frame_no, pts_s, width, height, format, payload) of a table of frames that a decoder has written: payloads of 24-bit colours with four bytes each, in order of frame_no; a payload whose size doesn't fit is an error.

    The table has stream, frame_no, width, height, payload, and pts and time_base, or frame_rate, from which the presentation time follows.
    """
    df = spark.read.parquet(path)
    seconds = F.col("pts") * F.col("time_base") if {"pts", "time_base"} <= set(df.columns) else F.col("frame_no") / F.col("frame_rate")
    fits = F.octet_length("payload") == F.col("width") * F.col("height") * 4
    return df.select(
        "stream", "frame_no", seconds.cast("double").alias("pts_s"), "width", "height", F.lit("xrgb8888").alias("format"),
        F.when(fits | F.col("payload").isNull(), F.col("payload")).otherwise(F.raise_error(F.lit("a payload doesn't fit its frame")).cast("binary")).alias("payload"),
    )


def read_metadata(source: str, is_file: bool) -> bytes:
    """Metadata from a file or a text: 1 to 65535 bytes."""
    if is_file:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(source) if "://" in source else (fs.LocalFileSystem(), source)
        with system.open_input_stream(at) as f:
            data = f.read()
    else:
        data = source.encode()
    if not 1 <= len(data) <= 65535:
        raise ValueError("metadata takes 1 to 65535 bytes")
    return data


def assert_uniform(images: DataFrame, *cols: str) -> DataFrame:
    """The images, or an error when they differ in one of the columns."""
    same = images.agg(*(F.min(c).alias(f"_lo_{c}") for c in cols), *(F.max(c).alias(f"_hi_{c}") for c in cols))  # one row
    j = images.crossJoin(F.broadcast(same))
    differ = F.lit(False)
    for c in cols:
        differ = differ | ~F.col(f"_lo_{c}").eqNullSafe(F.col(f"_hi_{c}"))
    first = cols[0]
    checked = F.when(differ, F.raise_error(F.lit("images differ in format or size"))).otherwise(F.col(first)).cast(images.schema[first].dataType)
    return j.withColumn(first, checked).select(*images.columns)
