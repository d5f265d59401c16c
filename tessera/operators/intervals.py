"""Overlapping and gapped time intervals: ordered disjoint-interval maps in keyed state.

Each key owns an ordered map of disjoint intervals. An insertion finds the intervals it touches by binary search, replaces them by their
union and updates the gaps. A key may hold any share of all rows: its time axis is cut into slots, every (key, slot) has a map
of its own, and the seams between slots are mended by one window over the slots' first starts and last ends. Repeated and nested
frames change nothing, so partial maps made before the shuffle are merged like frames.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


class IntervalMap:
    """Ordered map of disjoint half-open intervals; intervals that touch are one."""

    __slots__ = ("starts", "ends")

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def insert(self, start: int, end: int) -> None:
        """Insert [start, end); empty intervals are ignored."""
        if end <= start:
            return
        s, e = self.starts, self.ends
        if not s or start > e[-1]:
            s.append(start)
            e.append(end)
            return
        lo = bisect_left(e, start)  # first interval that ends at start or later
        hi = bisect_right(s, end)  # behind the last one that begins at end or earlier
        if lo < hi:
            start, end = min(start, s[lo]), max(end, e[hi - 1])
        s[lo:hi] = [start]
        e[lo:hi] = [end]

    def periods(self) -> list[tuple[int, int]]:
        return list(zip(self.starts, self.ends))

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.ends, self.starts[1:]))


def _ms(name: str):
    return F.round(F.col(name) * 1000).cast("long")


def frame_intervals(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, s, e) in whole milliseconds; frames with a null, NaN or infinite time or one beyond 9e12 s, whose milliseconds a long can't hold, or an end not after the start, fall out."""
    ok = F.col(start).isNotNull() & F.col(end).isNotNull() & ~F.isnan(F.col(start)) & ~F.isnan(F.col(end)) & (F.abs(start) < 9e12) & (F.abs(end) < 9e12)
    return df.filter(ok & (F.col(end) > F.col(start))).select(F.col(key).alias("key"), _ms(start).alias("s"), _ms(end).alias("e")).filter("e > s")


def _batch(cols: tuple[list, list, list, list], kind: pa.DataType) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, pa.int64(), pa.int64(), pa.int64()))], names=["key", "slot", "s", "e"])
    for c in cols:
        c.clear()
    return out


def _put(cols: tuple[list, list, list, list], key, slot: int, m: IntervalMap) -> None:
    n = len(m.starts)
    cols[0].extend([key] * n)
    cols[1].extend([slot] * n)
    cols[2].extend(m.starts)
    cols[3].extend(m.ends)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keyed state: one map for each (key, slot) of the partition; the maps' periods come out at its end.

    When the maps hold more than a million intervals they are given out early; the next stage merges them again.
    """
    state: dict[tuple, IntervalMap] = {}
    seen = 0
    kind: pa.DataType = pa.null()
    cols: tuple[list, list, list, list] = ([], [], [], [])

    def flush() -> pa.RecordBatch:
        for (key, slot), m in state.items():
            _put(cols, key, slot, m)
        state.clear()
        return _batch(cols, kind)

    for batch in batches:
        kind = batch.schema.field(0).type
        key, slot, s, e = (batch.column(i).to_pylist() for i in range(4))
        for k, b, x, y in zip(key, slot, s, e):
            m = state.get((k, b))
            if m is None:
                m = state[(k, b)] = IntervalMap()
            m.insert(x, y)
        seen += len(key)
        if seen > 1_000_000:
            yield flush()
            seen = 0
    if state:
        yield flush()


def _fold_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _fold, but the rows of a (key, slot) come together; the map of the one before is given out when the next begins."""
    now, m = None, IntervalMap()
    kind: pa.DataType = pa.null()
    cols: tuple[list, list, list, list] = ([], [], [], [])
    for batch in batches:
        kind = batch.schema.field(0).type
        key, slot, s, e = (batch.column(i).to_pylist() for i in range(4))
        for k, b, x, y in zip(key, slot, s, e):
            if now is None or k != now[0] or b != now[1]:
                if now is not None:
                    _put(cols, *now, m)
                now, m = (k, b), IntervalMap()
            m.insert(x, y)
        if len(cols[0]) > 10_000:
            yield _batch(cols, kind)
    if now is not None:
        _put(cols, *now, m)
    if cols[0]:
        yield _batch(cols, kind)


def merge_slots(iv: DataFrame, slot_ms: int) -> DataFrame:
    """Disjoint periods of every (key, slot); a frame belongs to the slot in which it starts, and may reach beyond it. Keys are of any simple type.

    At most ``slot_ms`` periods can start in a slot, whatever share of the rows its key has, which bounds every map.
    """
    types = f"key {iv.schema['key'].dataType.simpleString()}, slot long, s long, e long"
    local = iv.select("key", F.floor(F.col("s") / slot_ms).alias("slot"), "s", "e").mapInArrow(_fold, types)  # map-side merge
    return local.repartition("key", "slot").sortWithinPartitions("key", "slot").mapInArrow(_fold_sorted, types)


def _marked(df: DataFrame, key: str, start: str, end: str, slot_ms: int) -> tuple[DataFrame, DataFrame]:
    slots = merge_slots(frame_intervals(df, key, start, end), slot_ms)
    # one row per key and slot mends the seams: what reaches over from earlier slots is the largest end seen there
    wk = W.partitionBy("key").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    edges = slots.groupBy("key", "slot").agg(F.max("e").alias("last_e")).withColumn("carry", F.max("last_e").over(wk))
    ws = W.partitionBy("key", "slot").orderBy("s")
    b = edges.select(F.col("key").alias("k"), F.col("slot").alias("b"), "carry")
    marked = slots.join(b, [slots["key"].eqNullSafe(b["k"]), slots["slot"] == b["b"]]).select(
        "key", "slot", "s", "e", F.greatest(F.lag("e").over(ws), "carry").alias("before_e")
    )
    return marked, edges


def gaps(df: DataFrame, key: str, start: str, end: str, slot_ms: int = 600_000) -> DataFrame:
    """Gaps between the continuous periods of each key: ``key``, ``start_ms``, ``end_ms``.

    Half-open frames in whole milliseconds. Null keys form a key of their own; frames with a null or NaN time or an end not after the start are
    ignored; repeated and nested frames change nothing; an empty table gives no rows; extra columns are ignored.
    """
    marked, _ = _marked(df, key, start, end, slot_ms)
    return marked.filter("before_e < s").select("key", F.col("before_e").alias("start_ms"), F.col("s").alias("end_ms"))


def periods(df: DataFrame, key: str, start: str, end: str, slot_ms: int = 600_000) -> DataFrame:
    """Continuous periods of each key: ``key``, ``start_ms``, ``end_ms``; the cases are those of ``gaps``.

    A period begins where nothing reaches over, and ends where the next gap begins: in its own slot, or else at the first gap of the
    later slots, or else at the key's last end.
    """
    marked, _ = _marked(df, key, start, end, slot_ms)
    ws = W.partitionBy("key", "slot").orderBy("s")
    slots = marked.groupBy("key", "slot").agg(F.min(F.when(F.col("before_e") < F.col("s"), F.col("before_e"))).alias("gap_e"), F.max("e").alias("last_e"))
    later = W.partitionBy("key").orderBy("slot").rowsBetween(1, W.unboundedFollowing)
    slots = slots.select(
        F.col("key").alias("k"), F.col("slot").alias("b"), F.first("gap_e", True).over(later).alias("next_gap_e"), F.max("last_e").over(W.partitionBy("key")).alias("key_e")
    )
    begins = marked.filter("before_e IS NULL OR before_e < s").select("key", "slot", "s", F.lead("before_e").over(ws).alias("own_e"))
    return begins.join(slots, [begins["key"].eqNullSafe(slots["k"]), begins["slot"] == slots["b"]]).select(
        "key", F.col("s").alias("start_ms"), F.coalesce("own_e", "next_gap_e", "key_e").alias("end_ms")
    )
