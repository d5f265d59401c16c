"""Queries of the general training-data problems: records that don't load, interval periods and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.badrows import load_subtitle_frames
from tessera.operators.intervals import gaps, periods
from tessera.session import table


def _records(spark: SparkSession, d: str) -> DataFrame:
    return load_subtitle_frames(table(spark, d, "subtitle_raw").select("raw_id", "raw_record"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).filter("reason IS NOT NULL").select("raw_id", "reason")


def p1_frames(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).filter("reason IS NULL").select("raw_id", "sub_idx", "start_s", "end_s", "text")


def p1_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Rejected records with the edits that would mend them."""
    return _records(spark, d).filter("reason IS NOT NULL").select("raw_id", "reason", "edits")


def p1_edited(spark: SparkSession, d: str) -> DataFrame:
    """Rejected records, and whether edits would mend them: broken quoting and wrong numbers of fields need some, invalid values have none."""
    return _records(spark, d).filter("reason IS NOT NULL").select("raw_id", "reason", (F.col("edits") != "").alias("edited"))


def _frames(spark: SparkSession, d: str) -> DataFrame:
    # re-delivered rows repeat their times, which changes no period: they need no removal
    return table(spark, d, "subtitles").select("track_id", "start_s", "end_s")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    g = gaps(_frames(spark, d), "track_id", "start_s", "end_s")
    return g.select(F.col("key").alias("track_id"), F.col("start_ms").alias("gap_start_ms"), F.col("end_ms").alias("gap_end_ms"))


def p5_periods(spark: SparkSession, d: str) -> DataFrame:
    return periods(_frames(spark, d), "track_id", "start_s", "end_s").withColumnRenamed("key", "track_id")


_ISLANDS = """
WITH f AS (SELECT track_id, CAST(round(start_s * 1000) AS BIGINT) s, CAST(round(end_s * 1000) AS BIGINT) e FROM subtitles
           WHERE start_s IS NOT NULL AND end_s IS NOT NULL AND NOT isnan(start_s) AND NOT isnan(end_s) AND end_s > start_s),
m AS (SELECT *, max(e) OVER (PARTITION BY track_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) b FROM f WHERE e > s)
"""

_CSV = """
WITH r AS (SELECT raw_id, regexp_replace(raw_record, '(\\r\\n|\\n|\\r)$', '') t FROM subtitle_raw),
q AS (SELECT *, t IS NOT NULL AND regexp_full_match(t, '(?s)("([^"]|"")*"|[^,"][^,"]*|)(,("([^"]|"")*"|[^,"][^,"]*|))*') ok FROM r),
f AS (SELECT *, CASE WHEN ok THEN list_transform(regexp_extract_all(',' || t, '(?s),("(?:[^"]|"")*"|[^,"]*)', 1),
        lambda x: CASE WHEN x LIKE '"%' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) END a FROM q),
g AS (SELECT *, regexp_full_match(a[2], '[0-9]{2}:[0-5][0-9]:[0-5][0-9],[0-9]{3}') s_ok, regexp_full_match(a[3], '[0-9]{2}:[0-5][0-9]:[0-5][0-9],[0-9]{3}') e_ok FROM f),
c AS (SELECT raw_id, a, CASE WHEN t IS NULL THEN 'columns' WHEN NOT ok THEN 'quoting' WHEN len(a) <> 4 THEN 'columns'
  WHEN NOT regexp_full_match(a[1], '[0-9]+') OR regexp_full_match(a[1], '0+') THEN 'index'
  WHEN NOT s_ok THEN 'start' WHEN NOT e_ok THEN 'end' WHEN a[3] <= a[2] THEN 'order'
  WHEN regexp_full_match(a[4], '[ \\t\\r\\n]*') OR regexp_matches(a[4], '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') THEN 'text' END reason FROM g)
"""
_SECONDS = "(CAST(substr({0},1,2) AS BIGINT)*3600000 + CAST(substr({0},4,2) AS BIGINT)*60000 + CAST(substr({0},7,2) AS BIGINT)*1000 + CAST(substr({0},10,3) AS BIGINT)) / 1000.0"

SQL = {
    "p1_found": _CSV + "SELECT raw_id, reason FROM c WHERE reason IS NOT NULL",
    "p1_frames": _CSV
    + f"SELECT raw_id, CAST(a[1] AS BIGINT) sub_idx, {_SECONDS.format('a[2]')} start_s, {_SECONDS.format('a[3]')} end_s, a[4] AS text FROM c WHERE reason IS NULL",
    "p1_edited": _CSV + "SELECT raw_id, reason, reason IN ('quoting', 'columns') AS edited FROM c WHERE reason IS NOT NULL",
    "p5_found": _ISLANDS + "SELECT track_id, b AS gap_start_ms, s AS gap_end_ms FROM m WHERE b < s",
    "p5_periods": _ISLANDS
    + """, n AS (SELECT track_id, s, e, sum(CASE WHEN b IS NULL OR b < s THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) g FROM m)
SELECT track_id, min(s) AS start_ms, max(e) AS end_ms FROM n GROUP BY track_id, g""",
}

QUERIES = {f.__name__: f for f in (p1_found, p1_frames, p1_rejects, p1_edited, p5_found, p5_periods)}
