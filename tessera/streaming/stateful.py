"""Structured Streaming forms of the stateful operators: interval maps, frame deltas, re-windowing.

State is kept per key by Spark, survives restarts by checkpoints, and is as small as the operator allows. Input order within a key is arrival order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.intervals import IntervalMap, frame_intervals
from tessera.operators.temporal import Repackager


def interval_changes(stream: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Periods and gaps of each key after every micro-batch that changed them: (key, kind, start_ms, end_ms, version).

    The state of a key is its ordered disjoint-interval map; insertions find overlaps by binary search, merge them and update the gaps. Late frames are as good as
    others. Use the rows with a key's highest version.
    """

    def update(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = IntervalMap()
        version = 0
        if state.exists:
            version, starts, ends = state.get
            m.starts, m.ends = list(starts), list(ends)
        before = (list(m.starts), list(m.ends))
        for pdf in batches:
            for a, b in zip(pdf["s"].tolist(), pdf["e"].tolist()):
                m.insert(a, b)
        if (m.starts, m.ends) == before:
            return
        version += 1
        state.update((version, m.starts, m.ends))
        rows = [("period", a, b) for a, b in m.periods()] + [("gap", a, b) for a, b in m.gaps()]
        yield pd.DataFrame([(k[0], kind, a, b, version) for kind, a, b in rows], columns=["key", "kind", "start_ms", "end_ms", "version"])

    out = "key long, kind string, start_ms long, end_ms long, version int"
    iv = frame_intervals(stream, key, start, end)
    return iv.groupBy("key").applyInPandasWithState(update, out, "version int, starts array<long>, ends array<long>", "append", GroupStateTimeout.NoTimeout)


def frame_deltas(stream: DataFrame, key: str, frame_no: str, value: str, bits: int) -> DataFrame:
    """Frame differences whose state is the last difference; frames of a micro-batch are taken in order of ``frame_no``: (key, frame_no, diff)."""
    m = 1 << bits

    def update(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        pdf = pd.concat(list(batches)).sort_values(frame_no)
        out = []
        for no, v in zip(pdf[frame_no], pdf[value]):
            last = int(v) % m if last is None else (last - int(v)) % m
            out.append((k[0], int(no), last))
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, frame_no, "diff"])

    types = f"{key} {stream.schema[key].dataType.simpleString()}, {frame_no} long, diff long"
    return stream.select(key, frame_no, value).groupBy(key).applyInPandasWithState(update, types, "last long", "append", GroupStateTimeout.NoTimeout)


def repackage_stream(stream: DataFrame, key: str, seq: str, count: str, per_frame: float, modulo: int, idle_ms: int = 0) -> DataFrame:
    """Re-windowed sample counts of each key: (key, window_no, n_samples, padded). With ``idle_ms``, a key without input for that time is flushed."""

    def update(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        no, buffered, carry = state.get if state.exists else (0, 0, 0.0)
        r = Repackager(per_frame, modulo, buffered, carry)
        out = []
        if state.hasTimedOut:
            left = r.buffered
            n = r.flush()
            if n is not None:
                out.append((k[0], no, n, n - left))
            state.remove()
        else:
            pdf = pd.concat(list(batches)).sort_values(seq)
            for n in pdf[count]:
                got = r.push(int(n))
                if got is not None:
                    out.append((k[0], no, got, 0))
                    no += 1
            state.update((no, r.buffered, r.carry))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame(out, columns=[key, "window_no", "n_samples", "padded"])

    types = f"{key} {stream.schema[key].dataType.simpleString()}, window_no int, n_samples int, padded int"
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return stream.select(key, seq, count).groupBy(key).applyInPandasWithState(update, types, "no int, buffered long, carry double", "append", timeout)


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows per event-time window and key; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
