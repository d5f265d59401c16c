"""Frames as rows, and the two ways in which Python works on them: frame by frame, and as a fold over the frames of a stream.

A frame row has the keys ``stream`` and ``frame_no`` and the fields of ``FIELDS``; other columns pass through.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass(frozen=True)
class Frame:
    """An image: raw pixels of a format, with a palette if they are indices, screen maps if they are tiles, and the palette as raw data once it is."""

    width: int
    height: int
    format: str
    palette: list[int] | None
    palette_raw: bytes | None
    maps: list[list[int]] | None
    payload: bytes | None

    def with_(self, **changes: Any) -> Frame:
        return replace(self, **changes)


FIELDS = T.StructType(
    [
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("format", T.StringType()),
        T.StructField("palette", T.ArrayType(T.IntegerType())),
        T.StructField("palette_raw", T.BinaryType()),
        T.StructField("maps", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("payload", T.BinaryType()),
    ]
)
NAMES = FIELDS.names
assert NAMES == [f.name for f in fields(Frame)]


def _frame(row: tuple) -> Frame:
    w, h, fmt, pal, raw, maps, payload = row
    ints = lambda v: None if v is None else np.asarray(v, np.int64).tolist()
    return Frame(int(w), int(h), fmt, ints(pal), None if raw is None else bytes(raw), None if maps is None else [ints(m) for m in maps], None if payload is None else bytes(payload))


def _row(f: Frame) -> tuple:
    return tuple(getattr(f, n) for n in NAMES)


def complete(df: DataFrame) -> DataFrame:
    """Frames with all fields; those that are not there are null."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in FIELDS.fields if f.name not in df.columns})


def per_frame(df: DataFrame, fn: Callable[[Frame], Frame]) -> DataFrame:
    """``fn`` of every frame; frames without a payload stay as they are."""

    @F.pandas_udf(FIELDS)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [row if row[-1] is None else _row(fn(_frame(row))) for row in zip(*batch)]
            yield pd.DataFrame(rows, columns=NAMES).astype({"width": "Int32", "height": "Int32"})

    done = complete(df).withColumn("_f", run(*NAMES))
    return done.withColumns({n: F.col(f"_f.{n}") for n in NAMES}).drop("_f")


Fold = Callable[[Any, Frame], tuple[Any, Frame]]


def _folded(pdf: pd.DataFrame, states: Any, fn: Fold) -> tuple[pd.DataFrame, Any]:
    rows = []
    for row in zip(*(pdf[n] for n in NAMES)):
        if row[-1] is None:
            rows.append(row)
            continue
        states, f = fn(states, _frame(row))
        rows.append(_row(f))
    out = pdf.copy()
    for i, n in enumerate(NAMES):
        out[n] = pd.Series([r[i] for r in rows], index=pdf.index, dtype=object)
    return out.astype({"width": "Int32", "height": "Int32"}), states


def fold(df: DataFrame, fn: Fold) -> DataFrame:
    """``fn(state, frame)`` along the frames of each stream in order of frame_no; the first state is None. A stream is read batch by batch within its sorted partition."""
    df = complete(df)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, begun = None, None, False
        for pdf in batches:
            parts = []
            starts = [0, *(i for i in range(1, len(pdf)) if pdf["stream"].iloc[i] != pdf["stream"].iloc[i - 1]), len(pdf)]
            for a, b in zip(starts, starts[1:]):
                piece = pdf.iloc[a:b]
                if not len(piece):
                    continue
                key = piece["stream"].iloc[0]
                if not begun or key != now:
                    now, state, begun = key, None, True
                done, state = _folded(piece, state, fn)
                parts.append(done)
            if parts:
                yield pd.concat(parts)

    return df.repartition("stream").sortWithinPartitions("stream", "frame_no").mapInPandas(run, df.schema)


def fold_stream(df: DataFrame, fn: Fold) -> DataFrame:
    """``fold`` for streaming frames: Spark keeps each stream's state; frames of a micro-batch are taken in order of frame_no."""
    df = complete(df)
    names = df.columns

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = pickle.loads(state.get[0]) if state.exists else None
        pdf = pd.concat(list(batches)).sort_values("frame_no")
        done, now = _folded(pdf, now, fn)
        state.update((pickle.dumps(now),))
        yield done[names]

    out = df.groupBy("stream").applyInPandasWithState(update, df.schema, "state binary", "append", GroupStateTimeout.NoTimeout)
    # a condition that always holds: an Arrow UDF cannot take the rows of the stateful operator as they are, behind a generated filter it can
    return out.filter(F.length(F.coalesce(F.col("stream").cast("string"), F.lit(""))) >= 0)
