"""Block codecs: two end-point colours and 2-bit indices per block (DXT), and a motion codec over frames of such blocks (DXTV).

Blocks are rows and are fitted in Arrow batches; decoding is relational: bit arithmetic and a choice between four colours. Frames of a stream depend on each other; streams
run in parallel.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import color as C

_TOP = {"xrgb1555": np.array([31, 31, 31]), "rgb565": np.array([31, 63, 31])}


def distance(a: np.ndarray, b: np.ndarray, variant: str = "offset") -> np.ndarray:
    """Red-weighted distance of channels in 0..1, over the last axis; the offset form is the one end-points are tuned with."""
    mean = (a[..., 0] + b[..., 0]) / 2
    d = (a - b) ** 2
    base = (2 + mean) * d[..., 0] + 4 * d[..., 1]
    if variant == "weighted":
        return (base + (3 - mean) * d[..., 2]) / 9
    return np.where((d == 0).all(-1), 0, (base + 2 + (1 - mean) * d[..., 2]) / 9)


def snap(rgb: np.ndarray, fmt: str) -> np.ndarray:
    top = _TOP[fmt]
    return np.floor(np.clip(rgb, 0, 1) * top + 0.5) / top


#: Share of the first end-point in the colours of a block, by index; the last colour of the half mode is black.
_SHARE = {True: np.array([1.0, 0.0, 2 / 3, 1 / 3]), False: np.array([1.0, 0.0, 0.5, 0.0])}
#: Rounds of refinement; the floors of quality are met from the second on, and later ones still gain.
ROUNDS = 6


def _colors(a: np.ndarray, b: np.ndarray, third: bool, fmt: str) -> np.ndarray:
    """The four colours of each block, of shape (blocks, 4, 3)."""
    share = _SHARE[third][None, :, None]
    four = snap(a[:, None] * share + b[:, None] * (1 - share), fmt)
    if not third:
        four[:, 3] = 0
    return four


def _assign(px: np.ndarray, four: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(error of each block, index of each pixel)."""
    d = distance(px[:, :, None], four[:, None], "weighted")
    return d.min(2).sum(1), d.argmin(2)


def main_axis(px: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Colours of each block at the two ends of its main axis, the first eigenvector of its covariance."""
    mid = px - px.mean(1, keepdims=True)
    axis = np.linalg.eigh(np.einsum("bni,bnj->bij", mid, mid))[1][:, :, -1]
    along = np.einsum("bni,bi->bn", mid, axis)
    rows = np.arange(len(px))
    return px[rows, along.argmin(1)], px[rows, along.argmax(1)]


def _ends(px: np.ndarray, own: np.ndarray, third: bool, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """End-points of least squared error for given indices: each pixel is ``s a + (1 - s) b``; pixels that are black by their index say nothing."""
    s = _SHARE[third][own]
    used = np.ones(own.shape) if third else (own != 3).astype(float)
    u, v = s * used, (1 - s) * used
    uu, uv, vv = (u * u).sum(1), (u * v).sum(1), (v * v).sum(1)
    pu, pv = np.einsum("bn,bnc->bc", u, px), np.einsum("bn,bnc->bc", v, px)
    det = uu * vv - uv * uv
    ok = det > 1e-9
    det = np.where(ok, det, 1.0)[:, None]
    new_a = (pu * vv[:, None] - pv * uv[:, None]) / det
    new_b = (pv * uu[:, None] - pu * uv[:, None]) / det
    return np.where(ok[:, None], new_a, a), np.where(ok[:, None], new_b, b)


def fit_blocks(px: np.ndarray, fmt: str = "xrgb1555", rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first ends, second ends, third mode, index of each pixel) of blocks of RGB in 0..1, of shape (blocks, pixels, 3).

    From the ends of the main axis on, indices and end-points are found in turn, the end-points by least squares, in both modes and for all blocks at once; the best result of each block stays.
    """
    start = [snap(x, fmt) for x in main_axis(px)]
    n = len(px)
    best = np.full(n, np.inf)
    out_a, out_b, mode, index = np.zeros((n, 3)), np.zeros((n, 3)), np.zeros(n, bool), np.zeros(px.shape[:2], int)
    for third in (True, False):
        a, b = start
        for _ in range(rounds + 1):
            err, own = _assign(px, _colors(a, b, third, fmt))
            better = err < best - 1e-12
            best[better], mode[better] = err[better], third
            out_a[better], out_b[better], index[better] = a[better], b[better], own[better]
            new_a, new_b = (snap(x, fmt) for x in _ends(px, own, third, a, b))
            if (new_a == a).all() and (new_b == b).all():
                break
            a, b = new_a, new_b
    return out_a, out_b, mode, index


def _words(rgb: np.ndarray, fmt: str) -> np.ndarray:
    v = np.floor(rgb * _TOP[fmt] + 0.5).astype(np.int64)
    return v[:, 0] << (10 if fmt == "xrgb1555" else 11) | v[:, 1] << 5 | v[:, 2]


def encode_blocks(xrgb: np.ndarray, fmt: str = "xrgb1555", swap: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(colour words, packed indices) of blocks of packed colours, of shape (blocks, pixels): two words, and the bytes of 2-bit indices with the first in the low bits.

    The third mode has c0 > c1, the half mode c0 <= c1.
    """
    a, b, third, own = fit_blocks(_rgbf(xrgb), fmt)
    if swap:
        a, b = a[:, ::-1], b[:, ::-1]
    c0, c1 = _words(a, fmt), _words(b, fmt)
    same = third & (c0 == c1)
    own[same] = 0
    turn = np.where(third, c0 < c1, c0 > c1)
    c0, c1 = np.where(turn, c1, c0), np.where(turn, c0, c1)
    swapped = np.where(third[:, None], np.array([1, 0, 3, 2])[own], np.array([1, 0, 2, 3])[own])
    own = np.where(turn[:, None], swapped, own).reshape(len(own), -1, 4)
    return np.stack([c0, c1], 1).astype("<u2"), (own << np.array([0, 2, 4, 6])).sum(2).astype(np.uint8)


def encode_block(xrgb: np.ndarray, fmt: str = "xrgb1555", swap: bool = False) -> bytes:
    """One block of 4 x 4, 8 x 8 or 16 x 16: two colour words and 2-bit indices."""
    words, bits = encode_blocks(np.asarray(xrgb).reshape(1, -1), fmt, swap)
    return words.tobytes() + bits.tobytes()


def decode_blocks(words: np.ndarray, bits: np.ndarray, fmt: str = "xrgb1555", swap: bool = False) -> np.ndarray:
    """Packed colours of blocks, of shape (blocks, pixels)."""
    w = words.astype(np.int64)
    third = (w[:, 0] > w[:, 1])[:, None]
    shift, mid = (10, 31) if fmt == "xrgb1555" else (11, 63)
    ch = np.stack([w >> shift & 31, w >> 5 & mid, w & 31], 2)
    if swap:
        ch = ch[:, :, ::-1]
    a, b = ch[:, 0], ch[:, 1]
    two = np.where(third, (2 * a + b + 1) // 3, (a + b + 1) // 2)
    three = np.where(third, (a + 2 * b + 1) // 3, 0)
    four = np.stack([a, b, two, three], 1)
    r, g, bl = four[:, :, 0], four[:, :, 1], four[:, :, 2]
    wide = lambda v: (v * 527 + 23) >> 6
    pal = wide(r) << 16 | (wide(g) if fmt == "xrgb1555" else (g * 259 + 33) >> 6) << 8 | wide(bl)
    own = (bits[:, :, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).reshape(len(bits), -1)
    return np.take_along_axis(pal, own.astype(np.int64), 1)


def decode_block(data: bytes, pixels: int, fmt: str = "xrgb1555", swap: bool = False) -> np.ndarray:
    """Packed colours of one block."""
    return decode_blocks(np.frombuffer(data, "<u2", 2).reshape(1, 2), np.frombuffer(data, np.uint8, pixels // 4, 4).reshape(1, -1), fmt, swap)[0]


def _tiled(img: np.ndarray, size: int) -> np.ndarray:
    h, w = img.shape
    return img.reshape(h // size, size, w // size, size).swapaxes(1, 2).reshape(-1, size * size)


def encode_image(xrgb: np.ndarray, width: int, height: int, fmt: str = "xrgb1555", swap: bool = False) -> bytes:
    """Blocks of 4 x 4 in row order; all colour words first, then all indices."""
    if width % 4 or height % 4:
        raise ValueError("width and height must be multiples of 4")
    words, bits = encode_blocks(_tiled(np.asarray(xrgb).reshape(height, width), 4), fmt, swap)
    return words.tobytes() + bits.tobytes()


def decode_image(data: bytes, width: int, height: int, fmt: str = "xrgb1555", swap: bool = False) -> np.ndarray:
    n = width * height // 16
    blocks = decode_blocks(np.frombuffer(data, "<u2", 2 * n).reshape(n, 2), np.frombuffer(data, np.uint8, 4 * n, 4 * n).reshape(n, 4), fmt, swap)
    return blocks.reshape(height // 4, width // 4, 4, 4).swapaxes(1, 2).reshape(-1)


# --- relational decoder --------------------------------------------------------------------------------------------------


def decoded_pixel(c0: Column, c1: Column, index: Column, fmt: str = "xrgb1555") -> Column:
    """Colour of one pixel from the block's two words and the pixel's index."""
    third = c0 > c1
    a, b = C.channels(c0, fmt), C.channels(c1, fmt)
    two = tuple(F.when(third, F.floor((x * 2 + y + 1) / 3)).otherwise(F.floor((x + y + 1) / 2)) for x, y in zip(a, b))
    three = tuple(F.when(third, F.floor((x + y * 2 + 1) / 3)).otherwise(0) for x, y in zip(a, b))
    rgb = tuple(F.when(index == 0, x).when(index == 1, y).when(index == 2, p).otherwise(q) for x, y, p, q in zip(a, b, two, three))
    return C.convert_packed(C.pack(rgb, fmt), fmt, "xrgb8888")


# --- motion codec ----------------------------------------------------------------------------------------------------------

KEEP = 1
_REACH = range(-15, 17)


def dxtv_header(flags: Column, size: Column) -> Column:
    return flags.cast("long") + size.cast("long") * 256


def _rgbf(img: np.ndarray) -> np.ndarray:
    return np.stack([img >> 16 & 255, img >> 8 & 255, img & 255], -1) / 255.0


def _motion(block: np.ndarray, frame: np.ndarray, x: int, y: int, size: int, ready=None) -> tuple[float, int, int]:
    """Least distance of a block to those of a frame within reach, and the first offset that has it; ``ready`` (py, px) says which places may be used."""
    h, w = frame.shape[:2]
    top, left = max(0, y + _REACH[0]), max(0, x + _REACH[0])
    bottom, right = min(h - size, y + _REACH[-1]), min(w - size, x + _REACH[-1])
    if bottom < top or right < left:
        return np.inf, 0, 0
    area = frame[top : bottom + size, left : right + size]
    places = np.lib.stride_tricks.sliding_window_view(area, (size, size), (0, 1)).transpose(0, 1, 3, 4, 2)
    d = distance(block, places, "weighted").mean((2, 3))
    if ready is not None:
        d = np.where(ready(np.arange(top, bottom + 1)[:, None], np.arange(left, right + 1)[None]), d, np.inf)
    at = np.unravel_index(int(d.argmin()), d.shape)
    return float(d[at]), left + int(at[1]) - x, top + int(at[0]) - y


def dxtv_encode(img: np.ndarray, previous: np.ndarray | None, quality: int, fmt: str = "xrgb1555") -> tuple[bytes, np.ndarray]:
    """(frame, what a decoder sees of it). Blocks of 8 x 8 refer to the previous or the current frame, are DXT coded, or are split in four.

    An image that is all but equal to the previous one is a header of four bytes that says so.
    """
    h, w = img.shape
    if h % 8 or w % 8:
        raise ValueError("width and height must be multiples of 8")
    rgb = _rgbf(img)
    if previous is not None and float(distance(rgb, _rgbf(previous), "weighted").mean()) < 1e-4:
        return struct.pack("<I", KEEP | (h * w * 2) << 8), previous
    allowed = ((100 - quality) / 100) ** 2
    seen = np.zeros_like(img)
    now = _rgbf(seen)
    old = None if previous is None else _rgbf(previous)
    out = bytearray(struct.pack("<I", (h * w * 2) << 8))

    def code(x: int, y: int, size: int, last: bool) -> bytes | None:
        block = rgb[y : y + size, x : x + size]
        choices = []
        if old is not None:
            choices.append((*_motion(block, old, x, y, size), 1))
        row, col = y // 8 * 8, x // 8 * 8  # the rows of blocks above and the blocks to the left are decoded already
        choices.append((*_motion(block, now, x, y, size, lambda py, px: (py + size <= row) | ((px + size <= col) & (py + size <= row + 8))), 0))
        d, dx, dy, back = min(choices, key=lambda c: c[0])
        if d <= allowed:
            src = previous if back else seen
            seen[y : y + size, x : x + size] = src[y + dy : y + dy + size, x + dx : x + dx + size].copy()
            now[y : y + size, x : x + size] = _rgbf(seen[y : y + size, x : x + size])
            return struct.pack("<H", 1 << 15 | back << 14 | (dy + 15) << 5 | (dx + 15))
        data = encode_block(img[y : y + size, x : x + size].reshape(-1), fmt)
        got = decode_block(data, size * size, fmt).reshape(size, size)
        if not last and float(distance(block, _rgbf(got), "weighted").mean()) > allowed:
            return None
        seen[y : y + size, x : x + size] = got
        now[y : y + size, x : x + size] = _rgbf(got)
        return data

    for y in range(0, h, 8):
        for start in range(0, w, 128):
            flags, body = 0, bytearray()
            for i, x in enumerate(range(start, min(w, start + 128), 8)):
                data = code(x, y, 8, False)
                if data is None:
                    flags |= 1 << i
                    data = b"".join(code(x + ox, y + oy, 4, True) or b"" for oy in (0, 4) for ox in (0, 4))
                body += data
            out += struct.pack("<H", flags) + body
    out += b"\0" * (-len(out) % 4)
    return bytes(out), seen


def dxtv_decode(data: bytes, width: int, height: int, previous: np.ndarray | None, fmt: str = "xrgb1555") -> np.ndarray:
    """Image of a frame, given that of the frame before."""
    head = struct.unpack_from("<I", data)[0]
    if head & KEEP:
        if previous is None:
            raise ValueError("no frame to keep")
        return previous
    img = np.zeros((height, width), int)
    at = 4

    def block(x: int, y: int, size: int) -> None:
        nonlocal at
        word = struct.unpack_from("<H", data, at)[0]
        if word >> 15:
            src = previous if word >> 14 & 1 else img
            dx, dy = (word & 31) - 15, (word >> 5 & 31) - 15
            img[y : y + size, x : x + size] = src[y + dy : y + dy + size, x + dx : x + dx + size].copy()
            at += 2
        else:
            n = 4 + size * size // 4
            img[y : y + size, x : x + size] = decode_block(data[at : at + n], size * size, fmt).reshape(size, size)
            at += n

    for y in range(0, height, 8):
        for start in range(0, width, 128):
            flags = struct.unpack_from("<H", data, at)[0]
            at += 2
            for i, x in enumerate(range(start, min(width, start + 128), 8)):
                if flags >> i & 1:
                    for oy in (0, 4):
                        for ox in (0, 4):
                            block(x + ox, y + oy, 4)
                else:
                    block(x, y, 8)
    return img
