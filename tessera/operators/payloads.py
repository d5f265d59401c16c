"""Operators on whole payloads: byte histograms, deltas, words, interleaving, index packing, pixel layouts.

A payload stays one value of its row; it is worked on by numpy inside Arrow batches and never exploded to a row for each byte. Nulls stay null. Sizes that break a layout are errors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of the packed colour formats, and how many bytes a colour takes as raw data.
FORMATS = {"xrgb1555": 2, "rgb565": 2, "rgb888": 3, "xrgb8888": 4}


def mapped(fn: Callable, out: T.DataType, *cols: Column | str) -> Column:
    """``fn`` of the values of columns, row by row within Arrow batches; null if any of them is null."""

    @F.pandas_udf(out)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if any(v is None for v in row) else fn(*row) for row in zip(*batch)], dtype=object)

    # an iterator over a tuple of one series is what a single column gives as well
    @F.pandas_udf(out)
    def run_one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if v is None else fn(v) for v in s], dtype=object)

    return run(*cols) if len(cols) > 1 else run_one(*cols)


def _bytes(data) -> np.ndarray:
    return np.frombuffer(bytes(data), np.uint8)


def byte_histogram(payload: Column | str) -> Column:
    """Counts of the 256 byte values of a payload."""
    return mapped(lambda b: np.bincount(_bytes(b), minlength=256).tolist(), T.ArrayType(T.LongType()), payload)


def _as_words(data, width: int, pad: bool) -> np.ndarray:
    b = _bytes(data)
    if len(b) % width:
        if not pad:
            raise ValueError(f"{len(b)} bytes are no multiple of {width}")
        b = np.concatenate([b, np.zeros(-len(b) % width, np.uint8)])
    return b.view(f"<u{width}")


def words(payload: Column | str, width: int, pad: bool = False) -> Column:
    """Little-endian words of 1, 2 or 4 bytes as an array; with ``pad``, a last one that is short is filled with zero bytes."""
    return mapped(lambda b: _as_words(b, width, pad).astype(np.int64).tolist(), T.ArrayType(T.LongType()), payload)


def delta_bytes(data, width: int = 1) -> bytes:
    """The first word as it is, then differences modulo its range."""
    w = _as_words(data, width, False)
    return np.diff(w, prepend=w.dtype.type(0)).astype(w.dtype).tobytes()


def undelta_bytes(data, width: int = 1) -> bytes:
    w = _as_words(data, width, False)
    return np.cumsum(w, dtype=w.dtype).tobytes()


def delta_encode(payload: Column | str, width: int = 1) -> Column:
    return mapped(lambda b: delta_bytes(b, width), T.BinaryType(), payload)


def delta_decode(payload: Column | str, width: int = 1) -> Column:
    return mapped(lambda b: undelta_bytes(b, width), T.BinaryType(), payload)


def interleave_bytes(sets: list[bytes], bits: int) -> bytes:
    """Sets of equal size, value by value: a0 b0 a1 b1 ... of 8 bits, or of 15 or 16 bits as pairs of bytes.

    With 4 bits, sets come in pairs of nibbles: for each position first the low nibbles of all pairs, the first set of a pair in the low bits, then the high ones.
    """
    parts = [_bytes(s) for s in sets]
    if not parts or len({len(p) for p in parts}) > 1:
        raise ValueError("sets must have equal sizes")
    if bits == 8:
        return np.stack(parts, 1).tobytes()
    if bits in (15, 16):
        if len(parts[0]) % 2:
            raise ValueError("words of two bytes don't fill an odd size")
        return np.stack([p.view("<u2") for p in parts], 1).tobytes()
    if bits == 4:
        if len(parts) % 2:
            raise ValueError("nibbles need an even number of sets")
        low = np.stack([(a & 15) | (b & 15) << 4 for a, b in zip(parts[::2], parts[1::2])], 1)
        high = np.stack([a >> 4 | b >> 4 << 4 for a, b in zip(parts[::2], parts[1::2])], 1)
        return np.stack([low, high], 1).tobytes()
    raise ValueError(f"no such depth: {bits}")


def interleave(sets: Column | str, bits: int) -> Column:
    """Payload of an array of payloads, see ``interleave_bytes``."""
    return mapped(lambda s: interleave_bytes(list(s), bits), T.BinaryType(), sets)


def pack_index_bytes(indices, bits: int) -> bytes:
    """Indices of 1, 2 or 4 bits, the first in the low bits; larger ones and a number that doesn't fill its bytes are errors."""
    v = np.asarray(indices, np.int64)
    k = 8 // bits
    if len(v) % k:
        raise ValueError(f"{len(v)} indices don't fill bytes of {k}")
    if len(v) and (v.min() < 0 or v.max() >= 1 << bits):
        raise ValueError(f"an index takes more than {bits} bits")
    return (v.reshape(-1, k) << np.arange(k) * bits).sum(1).astype(np.uint8).tobytes()


def unpack_index_bytes(data, bits: int) -> list[int]:
    return (_bytes(data)[:, None] >> np.arange(8 // bits, dtype=np.uint8) * bits & (1 << bits) - 1).reshape(-1).astype(int).tolist()


def pack_indices(indices: Column | str, bits: int) -> Column:
    return mapped(lambda v: pack_index_bytes(v, bits), T.BinaryType(), indices)


def unpack_indices(payload: Column | str, bits: int) -> Column:
    return mapped(lambda b: unpack_index_bytes(b, bits), T.ArrayType(T.IntegerType()), payload)


def _scaled(v: np.ndarray, how: tuple[int, int, int]) -> np.ndarray:
    m, add, shift = how
    return v * m + add >> shift


# Factor, addend and shift of the rounded integer conversions of a channel.
_DOWN5, _DOWN6, _UP5, _UP6 = (249, 1014, 11), (253, 505, 10), (527, 23, 6), (259, 33, 6)


def pack_colors(xrgb: np.ndarray, fmt: str, swap: bool = False) -> np.ndarray:
    """Words of a format for packed 24-bit colours; ``swap`` exchanges red and blue."""
    r, g, b = xrgb >> 16 & 255, xrgb >> 8 & 255, xrgb & 255
    if fmt == "xrgb1555":
        r, g, b, at = _scaled(r, _DOWN5), _scaled(g, _DOWN5), _scaled(b, _DOWN5), (10, 5)
    elif fmt == "rgb565":
        r, g, b, at = _scaled(r, _DOWN5), _scaled(g, _DOWN6), _scaled(b, _DOWN5), (11, 5)
    else:
        at = (16, 8)
    if swap:
        r, b = b, r
    return r << at[0] | g << at[1] | b


def unpack_colors(words_: np.ndarray, fmt: str, swap: bool = False) -> np.ndarray:
    """Packed 24-bit colours of the words of a format."""
    if fmt in ("xrgb1555", "rgb565"):
        at, mask = (10, 31) if fmt == "xrgb1555" else (11, 63)
        r, g, b = words_ >> at & 31, words_ >> 5 & mask, words_ & 31
        if swap:
            r, b = b, r
        return _scaled(r, _UP5) << 16 | _scaled(g, _UP5 if fmt == "xrgb1555" else _UP6) << 8 | _scaled(b, _UP5)
    r, g, b = words_ >> 16 & 255, words_ >> 8 & 255, words_ & 255
    return b << 16 | g << 8 | r if swap else r << 16 | g << 8 | b


def color_bytes(xrgb, fmt: str, swap: bool = False) -> bytes:
    """Raw little-endian data of packed colours; none is an error."""
    v = np.asarray(xrgb, np.int64)
    if not len(v):
        raise ValueError("no colours")
    raw = pack_colors(v, fmt, swap).astype("<u4").view(np.uint8).reshape(-1, 4)
    return raw[:, : FORMATS[fmt]].tobytes()


def colors_of_bytes(data, fmt: str, swap: bool = False) -> list[int]:
    size = FORMATS[fmt]
    b = _bytes(data)
    if len(b) % size:
        raise ValueError(f"{len(b)} bytes are no multiple of {size}")
    full = np.zeros((len(b) // size, 4), np.uint8)
    full[:, :size] = b.reshape(-1, size)
    return unpack_colors(full.view("<u4").reshape(-1).astype(np.int64), fmt, swap).tolist()


def colors_to_raw(xrgb: Column | str, fmt: str, swap: bool = False) -> Column:
    return mapped(lambda v: color_bytes(v, fmt, swap), T.BinaryType(), xrgb)


def raw_to_colors(payload: Column | str, fmt: str, swap: bool = False) -> Column:
    return mapped(lambda b: colors_of_bytes(b, fmt, swap), T.ArrayType(T.IntegerType()), payload)


def indexed_to_colors(payload: Column | str, palette: Column | str, bits: int = 8) -> Column:
    """Packed colours of indexed raw data; an index beyond the palette is an error."""

    def look_up(data, pal) -> list[int]:
        p = np.asarray(pal, np.int64)
        v = _bytes(data).astype(np.int64) if bits == 8 else np.array(unpack_index_bytes(data, bits), np.int64)
        if len(v) and v.max() >= len(p):
            raise ValueError("an index lies beyond the palette")
        return p[v].tolist()

    return mapped(look_up, T.ArrayType(T.IntegerType()), payload, palette)


def combine_words(parts: list[bytes], width: int) -> tuple[bytes, list[int]]:
    """Payloads put behind each other, and where each starts in units of ``width`` bytes; sizes must be multiples of it."""
    at, starts = 0, []
    for p in parts:
        if len(p) % width:
            raise ValueError(f"{len(p)} bytes are no multiple of {width}")
        starts.append(at)
        at += len(p) // width
    return b"".join(map(bytes, parts)), starts


_COMBINED = T.StructType([T.StructField("data", T.BinaryType()), T.StructField("starts", T.ArrayType(T.LongType()))])


def combine(parts: Column | str, width: int = 1) -> Column:
    """Struct (data, starts) of an array of payloads."""

    @F.pandas_udf(_COMBINED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([combine_words(list(p), width) if p is not None else (None, None) for p in s], columns=_COMBINED.names)

    return run(parts)


def combine_maps(maps: list[list[list[int]]]) -> tuple[list[int], list[int]]:
    """Words of the screen maps of frames, and where they start: of a single frame that of each map, else that of each frame."""
    parts = maps[0] if len(maps) == 1 else [[w for m in frame for w in m] for frame in maps]
    starts = np.cumsum([0, *map(len, parts)])[:-1].tolist() if parts else []
    return [w for p in parts for w in p], starts


_MAPS = T.StructType([T.StructField("words", T.ArrayType(T.IntegerType())), T.StructField("starts", T.ArrayType(T.LongType()))])


def combine_map_data(maps: Column | str) -> Column:
    """Struct (words, starts) of an array of frames, each an array of maps, each an array of words."""

    @F.pandas_udf(_MAPS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([combine_maps([[list(m) for m in f] for f in x]) if x is not None else (None, None) for x in s], columns=_MAPS.names)

    return run(maps)


def pad_map_data(maps: Column, multiple: int) -> Column:
    """Every map of an array of maps filled with zeros to a multiple of words; empty ones stay empty."""
    return F.transform(maps, lambda m: F.when(F.size(m) == 0, m).otherwise(F.concat(m, F.array_repeat(F.lit(0), F.pmod(-F.size(m), F.lit(multiple))))))
