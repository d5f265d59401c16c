"""Pipelines of frame operators: a validated list of steps that compiles to one DataFrame plan.

A step is a function from DataFrame to DataFrame with a kind: ``convert`` works on single frames, ``state`` on the frames of a stream in order, ``batch`` on all frames at once,
``reduce`` makes one frame of many, ``output`` writes. Steps are lazy, so that a pipeline is one plan for the optimizer; only what a batch step needs to know of all frames is computed while the plan is built. The
steps that a reader must undo are known, and make up the inverse pipeline. The steps themselves are in ``image_steps`` and ``audio_steps``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("convert", "state", "batch", "reduce", "output")


@dataclass(frozen=True)
class StepType:
    """A registered kind of step: its function takes the frames and the parameters; ``stream`` is its form for streaming frames, if that differs."""

    name: str
    kind: str
    fn: Callable[..., DataFrame]
    params: tuple[tuple[str, type], ...] = ()
    undo: str | None = None
    stream: Callable[..., DataFrame] | None = None
    undo_params: tuple[str, ...] = ()


class Registry(dict[str, StepType]):
    """Step types by name."""

    def register(self, name: str, kind: str, params: tuple[tuple[str, type], ...] = (), undo: str | None = None, stream=None, undo_params: tuple[str, ...] = ()):
        if kind not in KINDS:
            raise ValueError(f"no such kind of step: {kind}")
        if name in self:
            raise ValueError(f"step {name} is there already")

        def add(fn):
            self[name] = StepType(name, kind, fn, params, undo, stream, undo_params)
            return fn

        return add


def check_params(t: StepType, params: dict[str, Any]) -> None:
    """An error unless the parameters have exactly the names and types of the step; numbers are no booleans."""
    want = dict(t.params)
    if set(params) != set(want) or any(not isinstance(params[k], want[k]) or isinstance(params[k], bool) != (want[k] is bool) for k in want):
        raise TypeError(f"{t.name} takes " + (", ".join(f"{k}: {v.__name__}" for k, v in t.params) or "no parameters"))


def require(condition: bool, message: str, error: type[Exception] = ValueError) -> None:
    """Precondition of a step."""
    if not condition:
        raise error(message)


@dataclass
class Pipeline:
    """Steps in order. ``add`` checks name and parameter types; ``run`` and ``run_stream`` compile the plan. States live within a run: each run begins with none."""

    registry: Registry
    steps: list[tuple[StepType, dict[str, Any], bool]] = field(default_factory=list)

    def add(self, name: str, record_size: bool = True, **params: Any) -> Pipeline:
        require(name in self.registry, f"no such step: {name}")
        t = self.registry[name]
        check_params(t, params)
        self.steps.append((t, params, record_size))
        return self

    def clear(self) -> None:
        self.steps.clear()

    def __len__(self) -> int:
        return len(self.steps)

    def __str__(self) -> str:
        return " -> ".join(t.name + (f"({', '.join(f'{k}={v!r}' for k, v in p.items())})" if p else "") for t, p, _ in self.steps)

    def _run(self, frames: DataFrame, stream: bool) -> DataFrame:
        df = frames.withColumn("max_memory", F.lit(0).cast("long")) if "max_memory" not in frames.columns else frames
        for i, (t, params, counted) in enumerate(self.steps):
            df = (t.stream if stream and t.stream else t.fn)(df, **params)
            if i and counted and t.kind not in ("reduce", "output") and {"payload", "max_memory"} <= set(df.columns):
                df = df.withColumn("max_memory", F.greatest("max_memory", (F.octet_length("payload") + 4).cast("long")))
        return df

    def run(self, frames: DataFrame) -> DataFrame:
        """Frames after all steps, with ``max_memory``: the largest payload plus 4 of any step but the first; reduce and output steps do not count."""
        return self._run(frames, False)

    def run_stream(self, frames: DataFrame) -> DataFrame:
        """As ``run`` for a streaming DataFrame; steps that need all frames are refused, not skipped."""
        bad = [t.name for t, _, _ in self.steps if t.kind in ("batch", "reduce")]
        require(not bad, f"not possible in a stream: {', '.join(bad)}")
        return self._run(frames, True)

    def inverse(self) -> Pipeline:
        """Pipeline that undoes the steps which can be undone, last one first."""
        out = Pipeline(self.registry)
        for t, p, _ in reversed(self.steps):
            if t.undo:
                out.add(t.undo, **{k: p[k] for k in t.undo_params})
        return out

    def decoding_steps(self) -> list[str]:
        return [t.name for t, _, _ in reversed(self.steps) if t.undo]


def counters(before: DataFrame, after: DataFrame, sizes: str = "payload") -> DataFrame:
    """One row: frames and bytes that went in and came out, their ratio in per cent, and the most memory any frame needs."""
    size = F.coalesce(F.sum(F.octet_length(sizes)), F.lit(0))
    a = before.agg(F.count("*").alias("frames_in"), size.alias("bytes_in"))
    b = after.agg(F.count("*").alias("frames_out"), size.alias("bytes_out"), F.max("max_memory").alias("max_memory"))
    return a.crossJoin(b).withColumn("ratio", F.when(F.col("bytes_in") > 0, F.round(F.col("bytes_out") * 100.0 / F.col("bytes_in"), 4)).otherwise(0.0))  # one row each
