"""Streams in time: caption lookup and injection, interleaving, duplicate frames, repackaging."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def active_intervals(points: DataFrame, intervals: DataFrame, key: str, t: str, start: str, end: str, slot: float) -> DataFrame:
    """Each point with the intervals of its key that hold it, ``start <= t < end``.

    The range join is an equi join on slots of time: an interval is put in every slot it reaches into, a point is in one. Choose ``slot`` near the usual length of an interval. Null times match nothing.
    """
    p = points.withColumn("_slot", F.floor(F.col(t) / slot))
    last = F.greatest(F.floor(F.col(start) / slot), F.ceil(F.col(end) / slot) - 1)
    i = intervals.filter(F.col(end) > F.col(start)).withColumn("_slot", F.explode(F.sequence(F.floor(F.col(start) / slot), last)))
    return p.join(i, [key, "_slot"]).filter((F.col(start) <= F.col(t)) & (F.col(t) < F.col(end))).drop("_slot")


def as_of(points: DataFrame, facts: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """Each point with the latest fact of its key at or before it; ties of time go to the larger value. One window over both inputs, no join."""
    a = points.withColumn("_v", F.lit(None).cast(facts.schema[value].dataType)).withColumn("_side", F.lit(1))
    b = facts.select(key, t, F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    w = W.partitionBy(key).orderBy(t, "_side", "_v").rowsBetween(W.unboundedPreceding, 0)
    return a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last("_v", True).over(w)).filter("_side = 1").drop("_v", "_side")


def inject(frames: DataFrame, captions: DataFrame, key: str, frame_no: str, t: str, cap_no: str, start: str) -> DataFrame:
    """Frame at which each caption goes out: at most one for each frame, in order, when the frame's time has reached the start: (key, cap_no, frame_no).

    With f the first frame that reaches a caption's start, the frame of caption i is the running maximum of ``f_j - j`` plus i. Captions that no frame is left for fall out. Frame and
    caption numbers count from 0 within their key.
    """
    a = frames.select(key, F.col(t).alias("_t"), F.lit(1).alias("_side"), F.col(frame_no).cast("long").alias("_n"))
    b = captions.select(key, F.col(start).alias("_t"), F.lit(0).alias("_side"), F.col(cap_no).cast("long").alias("_n"))
    ahead = W.partitionBy(key).orderBy("_t", "_side", "_n").rowsBetween(0, W.unboundedFollowing)
    j = a.unionByName(b).withColumn("_f", F.min(F.when(F.col("_side") == 1, F.col("_n"))).over(ahead)).filter("_side = 0 AND _f IS NOT NULL")
    run = W.partitionBy(key).orderBy("_n").rowsBetween(W.unboundedPreceding, 0)
    out = j.withColumn(frame_no, F.max(F.col("_f") - F.col("_n")).over(run) + F.col("_n"))
    count = frames.groupBy(key).agg(F.count("*").alias("_frames"))
    return out.join(count, key).filter(F.col(frame_no) < F.col("_frames")).select(key, F.col("_n").alias(cap_no), frame_no)


def interleave_streams(df: DataFrame, key: str, kind: str, order: list[str]) -> DataFrame:
    """Number of each frame within its kind, by which the kinds are read in turn: (.., turn)."""
    return df.withColumn("turn", F.row_number().over(W.partitionBy(key, kind).orderBy(*order)) - 1)


def drop_repeats(df: DataFrame, keys: list[str], order: list[str], value: str, tolerance: float) -> DataFrame:
    """Frames that differ from the last one that stayed by at least ``tolerance`` squared, so that a slow drift is not lost; the first stays, and so do frames without a value.

    What stays depends on what stayed before: the frames of a key are read in order, batch by batch, within its sorted partition, and the state is one value.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, None
        for pdf in batches:
            keep = []
            for k, v in zip(zip(*(pdf[c] for c in keys)), pdf[value]):
                if k != now:
                    now, last = k, None
                if v is None or v != v:
                    keep.append(True)
                    continue
                stays = last is None or (v - last) * (v - last) >= tolerance
                keep.append(stays)
                last = v if stays else last
            yield pdf[keep]

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, df.schema)


class Repackager:
    """Re-windowing of a stream of sample counts: windows of ``per_frame`` samples on average, each a multiple of ``modulo``.

    At most one window goes out for each input; what is rounded up is carried to the next window. ``flush`` gives the rest, padded.
    """

    def __init__(self, per_frame: float, modulo: int, buffered: int = 0, carry: float = 0.0) -> None:
        self.per_frame, self.modulo, self.buffered, self.carry = per_frame, modulo, buffered, carry

    def _round(self, n: int) -> int:
        return n + -n % self.modulo

    def push(self, n: int) -> int | None:
        self.buffered += n
        want = self._round(math.ceil(self.per_frame - self.carry))
        if self.buffered < want:
            return None
        self.buffered -= want
        self.carry += want - self.per_frame
        return want

    def flush(self) -> int | None:
        """Size of the last window, silence included."""
        if not self.buffered:
            return None
        n = self._round(self.buffered)
        self.buffered = 0
        self.carry += n - self.per_frame
        return n


def repackage(df: DataFrame, key: str, order: list[str], count: str, per_frame: float, modulo: int) -> DataFrame:
    """(key, window_no, n_samples, padded) of every stream.

    A stream's carry makes its windows depend on each other. The state is three numbers, and a stream is read batch by batch within its sorted partition, so that none is held
    in memory whole.
    """
    types = f"{key} string, window_no int, n_samples int, padded int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, r, no, rows = None, None, 0, []

        def close():
            nonlocal no
            if r is not None:
                left = r.buffered
                n = r.flush()
                if n is not None:
                    rows.append((now, no, n, n - left))

        for pdf in batches:
            for k, n in zip(pdf[key], pdf[count]):
                if r is None or k != now:
                    close()
                    now, r, no = k, Repackager(per_frame, modulo), 0
                got = r.push(int(n))
                if got is not None:
                    rows.append((now, no, got, 0))
                    no += 1
            if rows:
                yield pd.DataFrame(rows, columns=[key, "window_no", "n_samples", "padded"])
                rows.clear()
        close()
        if rows:
            yield pd.DataFrame(rows, columns=[key, "window_no", "n_samples", "padded"])

    return df.repartition(key).sortWithinPartitions(key, *order).select(key, count).mapInPandas(run, types)
