"""SubRip files: whole files are read, split into cues in the JVM, and written as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TIME = r"(\d{1,2}):(\d{2}):(\d{2})[,.](\d{1,3})"
_CUE = rf"(?s)\A\s*(\d+)[ \t]*\n[ \t]*{_TIME}\s*-->\s*{_TIME}[^\n]*\n?(.*)\z"


def _seconds(cue: Column, first: int) -> Column:
    g = lambda i: F.regexp_extract(cue, _CUE, first + i).cast("double")
    return g(0) * 3600 + g(1) * 60 + g(2) + g(3) / 1000


def escape_text(text: Column) -> Column:
    r"""Text that a cue carries unchanged: ``\\`` for a backslash, ``\r`` for a carriage return, and ``\|`` where a line is empty, and before and after blanks at its ends.

    SubRip ends a cue at a blank line and its readers trim lines; without the marks such texts come back cut.
    """
    t = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\r"), F.lit("\\r"))
    guard = lambda x: F.concat(F.when(x.rlike(r"\A([ \t]|\z)"), "\\|").otherwise(""), x, F.when(x.rlike(r"[ \t]\z"), "\\|").otherwise(""))
    return F.array_join(F.transform(F.split(t, "\n"), guard), "\n")


def unescape_text(text: Column) -> Column:
    """Text before ``escape_text``."""
    part = lambda x: F.replace(F.replace(x, F.lit("\\|"), F.lit("")), F.lit("\\r"), F.lit("\r"))
    return F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")


def parse_srt(files: DataFrame, key: str | list[str] = "path", text: str = "value", escaped: bool = False) -> DataFrame:
    """(key, sub_idx, start_s, end_s, text, ok) of every cue of whole-file texts; ``escaped`` takes back ``escape_text``.

    Lines are trimmed and runs of blank lines are one; ``sub_idx`` counts from 0 in file order. ``ok`` is false where the index is zero, a time is missing or the end isn't after the
    start; such a cue has null times. Null and empty files give no cue.
    """
    t = F.regexp_replace(F.regexp_replace(F.col(text), r"\r\n?", "\n"), r"[ \t]*\n[ \t]*", "\n")
    cues = F.filter(F.split(F.regexp_replace(t, "^﻿", ""), r"\n{2,}"), lambda c: F.trim(F.regexp_replace(c, "\n", " ")) != "")
    keys = [key] if isinstance(key, str) else key
    c = files.select(*keys, F.posexplode(cues).alias("sub_idx", "_c")).withColumn("_m", F.col("_c").rlike(_CUE))
    start, end = _seconds(F.col("_c"), 2), _seconds(F.col("_c"), 6)
    ok = F.col("_m") & (F.regexp_extract("_c", _CUE, 1).cast("long") > 0)
    c = c.withColumns({"start_s": F.when(ok, start), "end_s": F.when(ok, end)})
    good = ok & (F.col("end_s") > F.col("start_s"))
    body = F.trim(F.when(F.col("_m"), F.regexp_replace(F.regexp_extract("_c", _CUE, 10), r"\n+\z", "")).otherwise(F.col("_c")))
    if escaped:
        body = unescape_text(body)
    return c.select(*keys, "sub_idx", F.when(good, F.col("start_s")).alias("start_s"), F.when(good, F.col("end_s")).alias("end_s"), body.alias("text"), F.coalesce(good, F.lit(False)).alias("ok"))


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """Cues of all files that a path or pattern names."""
    files = spark.read.option("wholetext", True).text(path).withColumn("path", F.col("_metadata.file_path"))
    return parse_srt(files)


def srt_time(seconds: Column) -> Column:
    ms = F.round(seconds * 1000).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    part = lambda d, m: F.floor(ms / d) % m
    return F.concat(two(part(3_600_000, 100)), F.lit(":"), two(part(60_000, 60)), F.lit(":"), two(part(1000, 60)), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))


def srt_cue(number: Column, start: Column, end: Column, text: Column) -> Column:
    """Text of one cue; a text with blank lines, carriage returns, or blanks at line ends needs ``escape_text``."""
    return F.concat(number.cast("string"), F.lit("\n"), srt_time(start), F.lit(" --> "), srt_time(end), F.lit("\n"), text, F.lit("\n"))
