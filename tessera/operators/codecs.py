"""Dictionary and entropy coders for binary payloads: LZ4-40, LZSS-10 and rANS-50 streams.

A payload is coded as one unit, payloads are coded in parallel: the coders run in Arrow-batched UDFs over the ``payload`` column. All streams begin
with a little-endian word of ``size << 8 | marker``; sizes are limited to 2^24 - 1 bytes. Empty or null payloads can't be coded and give null.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Markers and limits of the formats.
LZ4_MARK, LZSS_MARK, RANS_MARK = 0x40, 0x10, 0x50
LZ4_MIN, LZ4_MAX, LZ4_FAR = 4, 783, 65535
LZSS_MIN, LZSS_MAX, LZSS_FAR = 3, 18, 4096
RANS_BITS, RANS_LOW = 14, 1 << 23
RANS_SINGLE, RANS_TABLE = 0x00, 0x40
LIMIT = 1 << 24
#: Longest match of each stored size of an LZ4 length below LZ4_MAX.
LZ4_STEPS = (17, 272, 527, 782)


class CodecError(ValueError):
    """A stream that breaks its format."""


def _head(size: int, mark: int) -> bytes:
    if not 0 < size < LIMIT:
        raise CodecError(f"size {size} is not in 1..{LIMIT - 1}")
    return struct.pack("<I", size << 8 | mark)


def _size(data: bytes, mark: int) -> int:
    if len(data) < 5:
        raise CodecError("stream too short")
    word = struct.unpack_from("<I", data)[0]
    if word & 255 != mark or not word >> 8:
        raise CodecError("no such stream")
    return word >> 8


def _pad(out: bytearray) -> bytes:
    out.extend(b"\0" * (-len(out) % 4))
    return bytes(out)


def suffix_order(data: bytes, depth: int) -> np.ndarray:
    """Positions in the order of the texts that begin there, compared over ``depth`` bytes at least; ties in order of position."""
    n = len(data)
    a = np.zeros(n + 8, np.uint64)
    a[:n] = np.frombuffer(data, np.uint8)
    key = a[:n].copy()
    for j in range(1, 8):
        key = key << np.uint64(8) | a[j : n + j]
    known = 8
    while True:
        order = np.argsort(key, kind="stable")
        k = key[order]
        steps = np.concatenate(([0], np.cumsum(k[1:] != k[:-1])))
        if known >= depth or steps[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = steps
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - known)] = rank[known:] + 1
        key = rank * (n + 1) + behind
        known *= 2


def _common(words: np.ndarray, a: np.ndarray, b: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Length of the common beginning of the texts at two positions, up to ``top``; all pairs at once, eight bytes a step."""
    k = np.zeros(len(a), np.int64)
    act = np.nonzero(b >= 0)[0]
    while len(act):
        x = words[a[act] + k[act]] ^ words[b[act] + k[act]]
        k[act] += sum((x < np.uint64(1 << 64 - 8 * j)).astype(np.int64) for j in range(1, 8)) + (x == 0)
        act = act[(x == 0) & (k[act] < top[act])]
    return np.minimum(k, top)


def _matches_all(data: bytes, order: np.ndarray, least: int, most: int) -> tuple[list[int], list[int]]:
    """``matches`` of data that fits the window: the longest match of a position is with one of its two neighbours in suffix order among the positions before it."""
    n = len(data)
    before, behind = [-1] * n, [-1] * n
    stack: list[int] = []
    for i in order.tolist():
        while stack and stack[-1] > i:
            behind[stack.pop()] = i
        if stack:
            before[i] = stack[-1]
        stack.append(i)
    padded = np.zeros(n + most + 16, np.uint64)
    padded[:n] = np.frombuffer(data, np.uint8)
    words = np.zeros(n + most + 8, np.uint64)
    for j in range(8):
        words = words << np.uint64(8) | padded[j : j + len(words)]
    at = np.arange(n)
    top = np.minimum(most, n - at)
    p, q = np.array(before), np.array(behind)
    x, y = _common(words, at, p, top), _common(words, at, q, top)
    other = (y > x) | (y == x) & (q > p)
    length, place = np.where(other, y, x), np.where(other, q, p)
    ok = length >= least
    return np.where(ok, length, 0).tolist(), np.where(ok, at - place, 0).tolist()


def matches(data: bytes, least: int, most: int, far: int, skip_next: bool = False) -> tuple[list[int], list[int]]:
    """Longest earlier match of every position: (lengths, distances); 0 where there is none.

    The places of the window are kept in suffix order: the longest match is always at a neighbour of the position there, so no place is left out. ``skip_next`` leaves out
    distance 1, for memories that are written in units of two bytes.
    """
    n = len(data)
    lengths, distances = [0] * n, [0] * n
    if n <= least:
        return lengths, distances
    by_rank = suffix_order(data, most)
    if n <= far and not skip_next:
        return _matches_all(data, by_rank, least, most)
    ranks = np.empty(n, np.int64)
    ranks[by_rank] = np.arange(n)
    order, rank = by_rank.tolist(), ranks.tolist()
    window: list[int] = []
    gap = 2 if skip_next else 1
    for i in range(gap, n - least + 1):
        insort(window, rank[i - gap])
        if i > far:
            del window[bisect_left(window, rank[i - far - 1])]
        at = bisect_left(window, rank[i])
        head = data[i : i + least]
        top = min(most, n - i)
        best = back = 0
        for r in window[max(at - 1, 0) : at + 1]:
            p = order[r]
            if data[p : p + least] != head:
                continue
            k = least
            while k + 16 <= top and data[p + k : p + k + 16] == data[i + k : i + k + 16]:
                k += 16
            while k < top and data[p + k] == data[i + k]:
                k += 1
            if k > best or k == best and i - p < back:
                best, back = k, i - p
        lengths[i], distances[i] = best, back
    return lengths, distances


def cheapest_parse(lengths: list[int], least: int, literal: float, match: Callable[[int], float], steps: tuple[int, ...] | None = None) -> list[int]:
    """Length of the step at every position (1: a literal) that makes the rest of the stream shortest; found from the end.

    Every length is tried. With ``steps``, the longest length of each cost, only these and the longest match are: as long as ``least - 1`` literals cost no more than a match,
    a later end is never worse at the same cost. The bytes that long runs of literals add aren't counted.
    """
    n = len(lengths)
    cost = [0.0] * (n + 1)
    step = [1] * n
    price = [match(k) if k >= least else 0.0 for k in range(max(lengths, default=0) + 1)]
    for i in range(n - 1, -1, -1):
        best, pick = literal + cost[i + 1], 1
        top = lengths[i]
        if top >= least:
            for k in range(least, top + 1) if steps is None else (*(k for k in steps if k < top), top):
                c = price[k] + cost[i + k]
                if c <= best:
                    best, pick = c, k
        cost[i], step[i] = best, pick
    return step


def _run(n: int) -> bytes:
    """Rest of a length from 15 on: bytes of 255 and a last one below."""
    return b"\xff" * (n // 255) + bytes([n % 255])


def lz4_encode(data: bytes, skip_next: bool = False) -> bytes:
    out = bytearray(_head(len(data), LZ4_MARK))
    lengths, distances = matches(data, LZ4_MIN, LZ4_MAX, LZ4_FAR, skip_next)
    extra = lambda k: 0 if k < 15 else (k - 15) // 255 + 1
    step = cheapest_parse(lengths, LZ4_MIN, 1.0, lambda k: 3 + extra(k - LZ4_MIN + 1), LZ4_STEPS)
    i = lit = 0
    n = len(data)
    while i < n:
        while i < n and step[i] == 1:
            i += 1
        text = data[lit:i]
        hi, lo, tail = min(len(text), 15), 0, b""
        if i < n:
            k = step[i] - LZ4_MIN + 1
            lo = min(k, 15)
            tail = struct.pack(">H", distances[i]) + (_run(k - 15) if lo == 15 else b"")
            i += step[i]
        out.append(hi << 4 | lo)
        if hi == 15:
            out += _run(len(text) - 15)
        out += text + tail
        lit = i
    return _pad(out)


def lz4_decode(data: bytes) -> bytes:
    size = _size(data, LZ4_MARK)
    out = bytearray()
    at = 4
    try:
        while len(out) < size:
            token = data[at]
            at += 1
            part = token >> 4
            if part == 15:
                while True:
                    part += data[at]
                    at += 1
                    if data[at - 1] != 255:
                        break
            out += data[at : at + part]
            at += part
            k = token & 15
            if not k:
                continue
            back = data[at] << 8 | data[at + 1]
            at += 2
            if k == 15:
                while True:
                    k += data[at]
                    at += 1
                    if data[at - 1] != 255:
                        break
            _copy(out, back, k + LZ4_MIN - 1)
    except IndexError:
        raise CodecError("stream ends early") from None
    return _exact(out, size)


def _copy(out: bytearray, back: int, k: int) -> None:
    if not 0 < back <= len(out):
        raise CodecError("distance beyond the start")
    start = len(out) - back
    piece = out[start : start + k]
    while len(piece) < k:  # a copy that overlaps itself repeats its piece
        piece += piece[: k - len(piece)]
    out += piece


def _exact(out: bytearray, size: int) -> bytes:
    if len(out) != size:
        raise CodecError("wrong size")
    return bytes(out)


def lzss_encode(data: bytes, skip_next: bool = False) -> bytes:
    out = bytearray(_head(len(data), LZSS_MARK))
    lengths, distances = matches(data, LZSS_MIN, LZSS_MAX, LZSS_FAR, skip_next)
    step = cheapest_parse(lengths, LZSS_MIN, 1.125, lambda k: 2.125)
    i = bit = 0
    flags = 0
    while i < len(data):
        if not bit:
            flags = len(out)
            out.append(0)
            bit = 0x80
        k = step[i]
        if k == 1:
            out.append(data[i])
        else:
            word = (k - LZSS_MIN) << 12 | (distances[i] - 1)
            out += struct.pack(">H", word)
            out[flags] |= bit
        i += k
        bit >>= 1
    return _pad(out)


def lzss_decode(data: bytes) -> bytes:
    size = _size(data, LZSS_MARK)
    out = bytearray()
    at = 4
    try:
        while len(out) < size:
            flags = data[at]
            at += 1
            for bit in range(7, -1, -1):
                if len(out) >= size:
                    break
                if flags >> bit & 1:
                    word = data[at] << 8 | data[at + 1]
                    at += 2
                    _copy(out, (word & 0xFFF) + 1, min((word >> 12) + LZSS_MIN, size - len(out)))
                else:
                    out.append(data[at])
                    at += 1
    except IndexError:
        raise CodecError("stream ends early") from None
    return _exact(out, size)


def rans_counts(hist: np.ndarray) -> np.ndarray:
    """Counts of 256 symbols scaled to 2^14: rounded, at least 1, and mended one by one in order of the fractions (ties: the lower symbol)."""
    total, m = int(hist.sum()), 1 << RANS_BITS
    exact = hist * float(m) / total
    counts = np.where(hist > 0, np.clip(np.floor(exact + 0.5), 1, m - 1), 0).astype(np.int64)
    lack = m - int(counts.sum())
    present = np.nonzero(hist)[0]
    fraction = (exact - np.floor(exact))[present]
    order = present[np.lexsort((present, -fraction if lack > 0 else fraction))]
    sign = 1 if lack > 0 else -1
    while lack:
        for s in order:
            if lack and (counts[s] < m - 1 if sign > 0 else counts[s] > 1):
                counts[s] += sign
                lack -= sign
    return counts


def rans_encode(data: bytes) -> bytes:
    out = bytearray(_head(len(data), RANS_MARK))
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    if (hist > 0).sum() == 1:
        return bytes(out) + bytes([RANS_SINGLE, data[0]])
    counts = rans_counts(hist)
    starts = (np.cumsum(counts) - counts).tolist()
    out.append(RANS_TABLE)
    out += counts.astype("<u2").tobytes()
    c = counts.tolist()
    x = RANS_LOW
    tail = bytearray()
    for s in reversed(data):
        n = c[s]
        top = (RANS_LOW >> RANS_BITS << 8) * n
        while x >= top:
            tail.append(x & 255)
            x >>= 8
        q, r = divmod(x, n)
        x = (q << RANS_BITS) + r + starts[s]
    state = x.to_bytes((x.bit_length() + 7) // 8, "big")
    out.append(len(state))
    out += state
    out += tail[::-1]
    return _pad(out)


def rans_decode(data: bytes) -> bytes:
    size = _size(data, RANS_MARK)
    if len(data) < 6:
        raise CodecError("stream too short")
    if data[4] & 0xC0 == RANS_SINGLE:
        return bytes([data[5]]) * size
    if data[4] & 0xC0 != RANS_TABLE or len(data) < 5 + 512 + 1:
        raise CodecError("no such stream")
    counts = np.frombuffer(data, "<u2", 256, 5).astype(np.int64)
    if counts.sum() != 1 << RANS_BITS:
        raise CodecError("bad counts")
    starts = (np.cumsum(counts) - counts).tolist()
    symbols = np.repeat(np.arange(256), counts).tolist()
    c = counts.tolist()
    at = 5 + 512
    n = data[at]
    x = int.from_bytes(data[at + 1 : at + 1 + n], "big")
    at += 1 + n
    out = bytearray(size)
    mask = (1 << RANS_BITS) - 1
    try:
        for i in range(size):
            low = x & mask
            s = symbols[low]
            out[i] = s
            x = c[s] * (x >> RANS_BITS) + low - starts[s]
            while x < RANS_LOW:
                x = x << 8 | data[at]
                at += 1
    except IndexError:
        if i + 1 < size:
            raise CodecError("stream ends early") from None
    return bytes(out)


CODERS = {"lz4": (lz4_encode, lz4_decode), "lzss": (lzss_encode, lzss_decode), "rans": (rans_encode, rans_decode)}


def _apply(fn: Callable[[bytes], bytes], payload: Column) -> Column:
    @F.pandas_udf(T.BinaryType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda b: fn(bytes(b)) if b is not None and len(b) else None)

    return run(payload)


def encode(payload: Column, coder: str) -> Column:
    """Coded stream of a binary column; coder is lz4, lzss or rans."""
    return _apply(CODERS[coder][0], payload)


def decode(payload: Column, coder: str) -> Column:
    return _apply(CODERS[coder][1], payload)
