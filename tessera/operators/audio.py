"""Audio samples: format conversion, planar and interleaved layouts, sample buffers, IMA ADPCM, resampling, re-windowing.

Samples are arrays of planar values: all of the first channel, then all of the second. Streams are read in order, one after the other within their sorted partitions.
"""

from __future__ import annotations

import pickle
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.payloads import mapped

# Step sizes and index changes of IMA ADPCM with 4 bits.
INDEX_CHANGE = (-1, -1, -1, -1, 2, 4, 6, 8)
STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449,
    494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493,
    10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)


def to_signed16(s: Column, fmt: str) -> Column:
    """Samples of s8, u8, s16, u16 or f32 as signed 16-bit ones; signed bytes are taken as signed."""
    if fmt == "s8":
        return (s + 128) * 257 - 32768
    if fmt == "u8":
        return s * 257 - 32768
    if fmt == "u16":
        return s - 32768
    if fmt == "f32":
        x = F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), s * 32768))
        return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("int")
    return s


def interleaved_position(channel: Column, pos: Column, channels: int) -> Column:
    """Place of a planar sample in L0 R0 L1 R1 order."""
    return pos * channels + channel


def planar_position(channel: Column, pos: Column, per_channel: int) -> Column:
    return channel * per_channel + pos


def samples_per_channel(samples: Column, channels: int) -> Column:
    return F.floor(F.size(samples) / channels)


SILENCE = {"s8": 0, "u8": 128, "s16": 0, "u16": 32768, "f32": 0.0}


def adpcm_header(channels: Column, size: Column, pcm_bits: int = 16, bits: int = 4) -> Column:
    """Frame header word: 5 bits of flags, 2 of channels, 6 and 3 of sample bits, 16 of the uncompressed size."""
    return F.shiftleft(channels.cast("long"), 5) + (pcm_bits << 7) + (bits << 13) + size.cast("long") * 65536


def adpcm_header_fields(word: Column) -> dict[str, Column]:
    at = lambda s, n: F.shiftright(word, s).bitwiseAND(F.lit((1 << n) - 1).cast("long"))
    return {"flags": at(0, 5), "channels": at(5, 2), "pcm_bits": at(7, 6), "adpcm_bits": at(13, 3), "size": at(16, 16)}


# --- sample layouts --------------------------------------------------------------------------------------------------------

DTYPES = {"s8": "i1", "u8": "u1", "s16": "<i2", "u16": "<u2", "f32": "<f4"}


def signed16(samples: np.ndarray, fmt: str) -> np.ndarray:
    """Samples of any format as signed 16-bit ones."""
    x = np.asarray(samples)
    if fmt == "s8":
        return ((x.astype(np.int64) + 128) * 257 - 32768).astype(np.int16)
    if fmt == "u8":
        return (x.astype(np.int64) * 257 - 32768).astype(np.int16)
    if fmt == "u16":
        return (x.astype(np.int64) - 32768).astype(np.int16)
    if fmt == "f32":
        return np.trunc(np.clip(x.astype(float) * 32768, -32768, 32767)).astype(np.int16)
    return x.astype(np.int16)


def from_unit(x: np.ndarray, fmt: str) -> np.ndarray:
    """Samples of a format for values in -1..1."""
    if fmt == "f32":
        return x.astype(np.float32)
    top = {"s8": 127, "u8": 127, "s16": 32767, "u16": 32767}[fmt]
    v = np.clip(np.floor(x * top + 0.5), -top - 1, top)
    return (v + {"u8": 128, "u16": 32768}.get(fmt, 0)).astype(DTYPES[fmt])


def to_unit(samples: np.ndarray, fmt: str) -> np.ndarray:
    """Values in -1..1 of samples."""
    x = np.asarray(samples).astype(float)
    if fmt == "f32":
        return x
    return (x - {"u8": 128, "u16": 32768}.get(fmt, 0)) / {"s8": 127, "u8": 127, "s16": 32767, "u16": 32767}[fmt]


def raw_bytes(samples, fmt: str, channels: int = 1, interleave: bool = False) -> bytes:
    """Bytes of planar samples as they are, or interleaved L0 R0 L1 R1; samples that don't fill the channels evenly are an error."""
    x = np.asarray(samples).astype(DTYPES[fmt])
    if len(x) % channels:
        raise ValueError(f"{len(x)} samples don't fill {channels} channels")
    return (x.reshape(channels, -1).T if interleave else x).tobytes()


def samples_of(data, fmt: str, channels: int = 1, interleaved: bool = False) -> np.ndarray:
    x = np.frombuffer(bytes(data), DTYPES[fmt])
    return x.reshape(-1, channels).T.reshape(-1) if interleaved else x


def to_raw(samples: Column | str, fmt: str, channels: int = 1, interleave: bool = False) -> Column:
    """Raw data of an array column of planar samples."""
    return mapped(lambda x: raw_bytes(x, fmt, channels, interleave), T.BinaryType(), samples)


def raw_size(samples: Column | str, fmt: str) -> Column:
    """Bytes that the samples take as raw data."""
    return F.size(samples) * np.dtype(DTYPES[fmt]).itemsize


class SampleBuffer:
    """Planar samples that are put in at the end and taken out at the front."""

    def __init__(self, channels: int, fmt: str) -> None:
        if channels < 1 or fmt not in DTYPES:
            raise ValueError("unknown channel or sample format")
        self.channels, self.fmt = channels, fmt
        self.data = np.zeros((channels, 0), DTYPES[fmt])

    def __len__(self) -> int:
        """Samples of each channel."""
        return self.data.shape[1]

    def push(self, samples) -> None:
        x = np.asarray(samples).astype(DTYPES[self.fmt])
        if len(x) % self.channels:
            raise ValueError(f"{len(x)} samples don't fill {self.channels} channels")
        self.data = np.concatenate([self.data, x.reshape(self.channels, -1)], 1)

    def push_silence(self, n: int) -> None:
        self.data = np.concatenate([self.data, np.full((self.channels, n), SILENCE[self.fmt], DTYPES[self.fmt])], 1)

    def pop(self, n: int) -> np.ndarray:
        """The first n samples of each channel, planar."""
        if n > len(self):
            raise ValueError(f"{n} samples of {len(self)}")
        out, self.data = self.data[:, :n].reshape(-1).copy(), self.data[:, n:]
        return out


# --- ADPCM -------------------------------------------------------------------------------------------------------------------

_NIBBLES = np.arange(16)
_S = np.array(STEPS)[:, None]
#: Change of the value and of the step index for each index and nibble.
_DELTA = ((_S >> 3) + np.where(_NIBBLES & 4, _S, 0) + np.where(_NIBBLES & 2, _S >> 1, 0) + np.where(_NIBBLES & 1, _S >> 2, 0)) * np.where(_NIBBLES & 8, -1, 1)
_NEXT = np.clip(np.arange(89)[:, None] + np.array(INDEX_CHANGE)[_NIBBLES & 7], 0, 88)


def adpcm_planes(x: np.ndarray, ahead: int = 3, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(first step index, nibbles) of planes of equal length, of shape (planes, samples); all planes are coded at once.

    A nibble is chosen by the least squared error over the next ``ahead`` samples, following the ``width`` best nibbles of each. There is no noise shaping.
    """
    x = np.asarray(x, np.int64)
    n, size = x.shape
    spread = np.abs(x[:, 1] - x[:, 0]) if size > 1 else np.zeros(n, np.int64)
    first = np.abs(np.array(STEPS)[None] - spread[:, None]).argmin(1)
    value, index = x[:, 0].copy(), first.copy()
    out = np.zeros((n, max(0, size - 1)), np.uint8)
    rows = np.arange(n)
    for t in range(1, size):
        v, i = value[:, None], index[:, None]  # of each path
        cost = np.zeros((n, 1))
        root = None  # first nibble of each path
        for k in range(min(ahead, size - t)):
            new = np.clip(v[:, :, None] + _DELTA[i], -32768, 32767)
            err = cost[:, :, None] + (new - x[:, t + k][:, None, None]) ** 2.0
            if k + 1 == min(ahead, size - t):
                best = err.reshape(n, -1).argmin(1)
                choice = best if root is None else root[rows, best // 16]
                break
            pick = np.argpartition(err, width - 1, 2)[:, :, :width] if width < 16 else np.broadcast_to(_NIBBLES, err.shape)
            take = lambda a: np.take_along_axis(a, pick, 2).reshape(n, -1)
            root = take(np.broadcast_to(_NIBBLES, err.shape)) if root is None else np.repeat(root, pick.shape[2], 1)
            v, cost, i = take(new), take(err), take(_NEXT[i])
        out[:, t - 1] = choice
        value = np.clip(value + _DELTA[index, choice], -32768, 32767)
        index = _NEXT[index, choice]
    return first, out


def _check_frame(planes: list[np.ndarray]) -> int:
    n = len(planes[0]) if planes else 0
    if not n or any(len(p) != n for p in planes) or len(planes) not in (1, 2) or n * 2 * len(planes) >= 1 << 16:
        raise ValueError("one or two planes of equal size, less than 64 KiB together")
    return n


def adpcm_encode_frames(frames: list[list[np.ndarray]], ahead: int = 3) -> list[bytes]:
    """Frames of 16-bit planes: header, then for each channel the first sample, the step index, a zero byte, and nibbles, low one first. Frames of one size are coded together."""
    out: list[bytes] = [b""] * len(frames)
    by_size: dict[tuple[int, int], list[int]] = {}
    for k, planes in enumerate(frames):
        by_size.setdefault((_check_frame(planes), len(planes)), []).append(k)
    for (n, c), at in by_size.items():
        x = np.array([p for k in at for p in frames[k]], np.int64)
        first, nibbles = adpcm_planes(x, ahead)
        if nibbles.shape[1] % 2:
            nibbles = np.concatenate([nibbles, np.zeros((len(x), 1), np.uint8)], 1)
        body = nibbles[:, ::2] | nibbles[:, 1::2] << 4
        head = struct.pack("<I", c << 5 | 16 << 7 | 4 << 13 | (n * 2 * c) << 16)
        for j, k in enumerate(at):
            out[k] = head + b"".join(struct.pack("<hBB", int(x[r, 0]), int(first[r]), 0) + body[r].tobytes() for r in range(j * c, j * c + c))
    return out


def adpcm_encode(planes: list[np.ndarray], ahead: int = 3) -> bytes:
    return adpcm_encode_frames([planes], ahead)[0]


def adpcm_decode(data: bytes) -> list[np.ndarray]:
    """Planes of a frame."""
    word = struct.unpack_from("<I", data)[0]
    channels, size = word >> 5 & 3, word >> 16
    if channels not in (1, 2) or (word >> 13 & 7) != 4 or size % (2 * channels):
        raise ValueError("no such frame")
    n = size // 2 // channels
    each = 4 + n // 2
    if len(data) < 4 + channels * each:
        raise ValueError("frame ends early")
    at, planes = 4, []
    for _ in range(channels):
        value, index, _zero = struct.unpack_from("<hBB", data, at)
        code = np.frombuffer(data, np.uint8, n // 2, at + 4)
        x = [value]
        for k in np.stack([code & 15, code >> 4], 1).reshape(-1)[: n - 1].tolist():
            value = max(-32768, min(32767, value + int(_DELTA[index, k])))
            index = int(_NEXT[index, k])
            x.append(value)
        at += each
        planes.append(np.array(x, np.int16))
    return planes


def adpcm(samples: Column | str, channels: int = 1, fmt: str = "s16") -> Column:
    """ADPCM frame of an array of planar samples; the frames of an Arrow batch are coded together."""

    @F.pandas_udf(T.BinaryType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            ok = [i for i, x in enumerate(s) if x is not None and len(x)]
            out: list[bytes | None] = [None] * len(s)
            for i, b in zip(ok, adpcm_encode_frames([list(signed16(np.asarray(s.iloc[i]), fmt).reshape(channels, -1)) for i in ok])):
                out[i] = b
            yield pd.Series(out, dtype=object)

    return run(samples)


def un_adpcm(payload: Column | str) -> Column:
    """Planar 16-bit samples of an ADPCM frame."""
    return mapped(lambda b: np.concatenate(adpcm_decode(bytes(b))).astype(int).tolist(), T.ArrayType(T.IntegerType()), payload)


# --- resampling ----------------------------------------------------------------------------------------------------------------


class Resampler:
    """Windowed-sinc resampling (Hann window) of one plane in pieces; the kernel widens when the rate falls. Pieces give the same as the whole at once."""

    def __init__(self, rate_in: int, rate_out: int, half: int = 16) -> None:
        if rate_in < 1 or rate_out < 1:
            raise ValueError("rates must be positive")
        self.rate_in, self.rate_out, self.half = rate_in, rate_out, half
        self.scale = min(1.0, rate_out / rate_in)
        self.reach = int(np.ceil(half / self.scale))
        self.kept = np.zeros(0)  # input from position ``start`` on
        self.start = self.seen = self.done = 0

    def _values(self, first: int, last: int) -> np.ndarray:
        t = np.arange(first, last) * self.rate_in / self.rate_out
        at = np.floor(t).astype(int)[:, None] + np.arange(-self.reach, self.reach + 1)[None]
        d = (t[:, None] - at) * self.scale
        w = np.sinc(d) * np.where(np.abs(d) < self.half, 0.5 + 0.5 * np.cos(np.pi * d / self.half), 0)
        i = at - self.start
        v = np.where((at >= 0) & (at < self.seen), self.kept[np.clip(i, 0, max(0, len(self.kept) - 1))] if len(self.kept) else 0.0, 0.0)
        norm = w.sum(1)
        return (w * v).sum(1) / np.where(norm == 0, 1, norm)

    def push(self, x) -> np.ndarray:
        """Output whose kernel lies within what came so far."""
        x = np.asarray(x, float)
        self.kept = np.concatenate([self.kept, x])
        self.seen += len(x)
        # the last output position whose kernel ends before ``seen``
        last = max(self.done, -(-(self.seen - self.reach) * self.rate_out // self.rate_in) if self.seen > self.reach else 0)
        out = self._values(self.done, last)
        self.done = last
        drop = max(0, int(self.done * self.rate_in // self.rate_out) - self.reach - self.start)
        self.kept, self.start = self.kept[drop:], self.start + drop
        return out

    def flush(self) -> np.ndarray:
        """The rest, with silence behind the end."""
        last = int(np.ceil(self.seen * self.rate_out / self.rate_in))
        out = self._values(self.done, max(self.done, last))
        self.done = max(self.done, last)
        return out


def resample(x: np.ndarray, rate_in: int, rate_out: int, half: int = 16) -> np.ndarray:
    """A whole plane at another rate."""
    r = Resampler(rate_in, rate_out, half)
    return np.concatenate([r.push(x), r.flush()])


def mix_channels(planes: np.ndarray, channels: int) -> np.ndarray:
    """Planes for another number of channels: one goes to all, several are averaged to one, more than are wanted are averaged in pairs of equal side."""
    have = len(planes)
    if have == channels:
        return planes
    if have == 1:
        return np.repeat(planes, channels, 0)
    if channels == 1:
        return planes.mean(0, keepdims=True)
    return np.stack([planes[i::channels].mean(0) for i in range(channels)])


def _streams(df: DataFrame, key: str, order: list[str], samples: str, schema: str, start, step, end) -> DataFrame:
    """Fold over the frames of each stream, which lies sorted in one partition and is read batch by batch: ``start()`` makes a state, ``step(state, samples)`` and ``end(state)`` give lists of rows."""
    kind = df.schema[key].dataType.simpleString()
    names = [key] + [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for pdf in batches:
            rows: list[tuple] = []
            for k, x in zip(pdf[key], pdf[samples]):
                if state is None or k != now:
                    if state is not None:
                        rows += [(now, *r) for r in end(state)]
                    now, state = k, start()
                if x is not None:
                    rows += [(now, *r) for r in step(state, np.asarray(x))]
            if rows:
                yield pd.DataFrame(rows, columns=names)
        if state is not None and (rows := [(now, *r) for r in end(state)]):
            yield pd.DataFrame(rows, columns=names)

    return df.filter(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order).select(key, samples).mapInPandas(run, f"{key} {kind}, {schema}")


def _streams_live(df: DataFrame, key: str, order: list[str], samples: str, schema: str, start, step, end, idle_ms: int = 0) -> DataFrame:
    """``_streams`` for streaming frames: Spark keeps each stream's state; with ``idle_ms``, a stream without input for that time is ended."""
    names = [key] + [c.split()[0] for c in schema.split(",")]

    def update(k, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state = pickle.loads(kept.get[0]) if kept.exists else start()
        rows: list[tuple] = []
        if kept.hasTimedOut:
            rows = [(k[0], *r) for r in end(state)]
            kept.remove()
        else:
            pdf = pd.concat(list(batches)).sort_values(order)
            for x in pdf[samples]:
                if x is not None:
                    rows += [(k[0], *r) for r in step(state, np.asarray(x))]
            kept.update((pickle.dumps(state),))
            if idle_ms:
                kept.setTimeoutDuration(idle_ms)
        if rows:
            yield pd.DataFrame(rows, columns=names)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, *order, samples).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, {schema}", "state binary", "append", timeout)


class _Resampled:
    """State of a stream: a resampler for each channel that goes out, and the number of the next frame."""

    schema = "frame_no int, samples array<double>"

    def __init__(self, rate_in: int, rate_out: int, channels_in: int, channels_out: int, fmt_in: str, fmt_out: str) -> None:
        self.args = rate_in, rate_out, channels_in, channels_out, fmt_in, fmt_out

    def start(self) -> list:
        return [[Resampler(*self.args[:2]) for _ in range(self.args[3])], 0]

    def _rows(self, state: list, planes: list[np.ndarray]) -> list[tuple]:
        if not len(planes[0]):
            return []
        state[1] += 1
        return [(state[1] - 1, from_unit(np.concatenate(planes), self.args[5]).astype(float).tolist())]

    def step(self, state: list, x: np.ndarray) -> list[tuple]:
        _, _, have, want, fmt, _ = self.args
        if len(x) % have:
            raise ValueError(f"{len(x)} samples don't fill {have} channels")
        return self._rows(state, [r.push(p) for r, p in zip(state[0], mix_channels(to_unit(x, fmt).reshape(have, -1), want))])

    def end(self, state: list) -> list[tuple]:
        return self._rows(state, [r.flush() for r in state[0]])


def resample_frames(df: DataFrame, key: str, order: list[str], samples: str, rate_in: int, rate_out: int, channels_in: int = 1, channels_out: int = 1, fmt_in: str = "s16", fmt_out: str = "s16") -> DataFrame:
    """(key, frame_no, samples): planar samples of each stream at another rate, channel count and format; the last frame is what remains at the end. Null frames are left out; frames too short for an output give none."""
    f = _Resampled(rate_in, rate_out, channels_in, channels_out, fmt_in, fmt_out)
    return _streams(df, key, order, samples, f.schema, f.start, f.step, f.end)


def resample_stream(df: DataFrame, key: str, order: list[str], samples: str, rate_in: int, rate_out: int, channels_in: int = 1, channels_out: int = 1, fmt_in: str = "s16", fmt_out: str = "s16", idle_ms: int = 0) -> DataFrame:
    """``resample_frames`` for streaming frames."""
    f = _Resampled(rate_in, rate_out, channels_in, channels_out, fmt_in, fmt_out)
    return _streams_live(df, key, order, samples, f.schema, f.start, f.step, f.end, idle_ms)


class _Repackaged:
    """State of a stream: what decides the sizes, the samples that wait, and the number of the next window."""

    schema = "window_no int, samples array<double>, padded int"

    def __init__(self, per_frame: float, modulo: int, channels: int, fmt: str) -> None:
        self.args = per_frame, modulo, channels, fmt

    def start(self) -> list:
        from tessera.operators.temporal import Repackager

        return [Repackager(*self.args[:2]), SampleBuffer(*self.args[2:]), 0]

    def _row(self, state: list, n: int | None, padded: int) -> list[tuple]:
        if n is None:
            return []
        state[2] += 1
        return [(state[2] - 1, state[1].pop(n).astype(float).tolist(), padded)]

    def step(self, state: list, x: np.ndarray) -> list[tuple]:
        before = len(state[1])
        state[1].push(x)
        return self._row(state, state[0].push(len(state[1]) - before), 0)

    def end(self, state: list) -> list[tuple]:
        left = state[0].buffered
        n = state[0].flush()
        if n is not None:
            state[1].push_silence(n - left)
        return self._row(state, n, (n or 0) - left)


def repackage_frames(df: DataFrame, key: str, order: list[str], samples: str, per_frame: float, modulo: int, channels: int = 1, fmt: str = "s16") -> DataFrame:
    """(key, window_no, samples, padded): planar samples of each stream in windows of ``per_frame`` samples on average, each a multiple of ``modulo``; silence fills the last one."""
    f = _Repackaged(per_frame, modulo, channels, fmt)
    return _streams(df, key, order, samples, f.schema, f.start, f.step, f.end)


def repackage_stream(df: DataFrame, key: str, order: list[str], samples: str, per_frame: float, modulo: int, channels: int = 1, fmt: str = "s16", idle_ms: int = 0) -> DataFrame:
    """``repackage_frames`` for streaming frames."""
    f = _Repackaged(per_frame, modulo, channels, fmt)
    return _streams_live(df, key, order, samples, f.schema, f.start, f.step, f.end, idle_ms)


def wav_header(channels: int, rate: int, bits: int, size: int) -> bytes:
    """Header of a PCM WAV file with ``size`` bytes of samples."""
    step = channels * bits // 8
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size, b"WAVE", b"fmt ", 16, 1, channels, rate, rate * step, step, bits, b"data", size)
