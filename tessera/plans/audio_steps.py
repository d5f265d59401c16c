"""Audio steps of pipelines: resampling, re-windowing, ADPCM, coders, raw data and padding.

A frame row has stream, frame_no, channels, sample_format, planar ``samples`` (array of doubles) and, once they are coded, ``payload``. What a stateful step needs to know of its input is a parameter, so that
plans are built without a look at the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import arrays, audio, codecs
from tessera.operators.payloads import mapped
from tessera.plans.pipeline import Registry, require

STEPS = Registry()


def _with_info(df: DataFrame, channels: int, fmt: str) -> DataFrame:
    return df.select("stream", "frame_no", F.lit(channels).alias("channels"), F.lit(fmt).alias("sample_format"), "samples", F.lit(None).cast("binary").alias("payload"), F.lit(0).cast("long").alias("max_memory"))


def _check(channels: int, fmt: str) -> None:
    require(channels in (1, 2) and fmt in audio.DTYPES, "unknown channel or sample format")


_RESAMPLE = (("rate_in", int), ("channels_in", int), ("format_in", str), ("rate", int), ("channels", int), ("format", str))


def _resampled(how):
    def step(df: DataFrame, rate_in: int, channels_in: int, format_in: str, rate: int, channels: int, format: str) -> DataFrame:
        _check(channels_in, format_in)
        _check(channels, format)
        return _with_info(how(df, "stream", ["frame_no"], "samples", rate_in, rate, channels_in, channels, format_in, format), channels, format)

    return step


#: Samples at another rate, number of channels and format; the frames of a stream follow each other, and what remains at its end is a last frame.
resample = STEPS.register("resample", "state", _RESAMPLE, stream=_resampled(audio.resample_stream))(_resampled(audio.resample_frames))

_REPACKAGE = (("channels", int), ("format", str), ("per_frame", float), ("modulo", int))


def _repackaged(how):
    def step(df: DataFrame, channels: int, format: str, per_frame: float, modulo: int) -> DataFrame:
        _check(channels, format)
        require(per_frame > 0 and modulo > 0, "sizes must be positive")
        out = how(df, "stream", ["frame_no"], "samples", per_frame, modulo, channels, format)
        return _with_info(out.withColumnRenamed("window_no", "frame_no"), channels, format)

    return step


#: Windows of ``per_frame`` samples on average, each a multiple of ``modulo``; the last one is filled with silence.
repackage = STEPS.register("repackage", "state", _REPACKAGE, stream=_repackaged(audio.repackage_stream))(_repackaged(audio.repackage_frames))


@F.pandas_udf(T.BinaryType())
def _adpcm(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for samples, channels, fmt in batches:
        ok = [i for i, x in enumerate(samples) if x is not None and len(x)]
        out: list[bytes | None] = [None] * len(samples)
        planes = [list(audio.signed16(np.asarray(samples.iloc[i]), fmt.iloc[i]).reshape(int(channels.iloc[i]), -1)) for i in ok]
        for i, b in zip(ok, audio.adpcm_encode_frames(planes)):
            out[i] = b
        yield pd.Series(out, dtype=object)


@STEPS.register("adpcm", "convert", undo="unadpcm")
def adpcm(df: DataFrame) -> DataFrame:
    return df.withColumn("payload", _adpcm("samples", "channels", "sample_format"))


@STEPS.register("unadpcm", "convert")
def unadpcm(df: DataFrame) -> DataFrame:
    return df.withColumn("samples", audio.un_adpcm("payload").cast("array<double>")).withColumn("sample_format", F.lit("s16"))


@STEPS.register("samples_to_raw", "convert", (("interleave", bool),))
def samples_to_raw(df: DataFrame, interleave: bool) -> DataFrame:
    """Raw data of the samples; frames that are coded already stay as they are."""
    raw = mapped(lambda x, c, fmt: audio.raw_bytes(x, fmt, int(c), interleave), T.BinaryType(), "samples", "channels", "sample_format")
    return df.withColumn("payload", F.coalesce("payload", raw) if "payload" in df.columns else raw)


@STEPS.register("pad_audio", "convert", (("multiple", int),))
def pad_audio(df: DataFrame, multiple: int) -> DataFrame:
    return df.withColumn("payload", arrays.pad_binary(F.col("payload"), multiple))


for _name in codecs.CODERS:
    STEPS.register(_name, "convert", undo=f"un{_name}")(lambda df, c=_name: df.withColumn("payload", codecs.encode(F.col("payload"), c)))
    STEPS.register(f"un{_name}", "convert")(lambda df, c=_name: df.withColumn("payload", codecs.decode(F.col("payload"), c)))
