"""Tables read as the data that frame operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import table


def payloads(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, payload): the UTF-8 bytes of every document."""
    return table(spark, d, "documents").filter("text IS NOT NULL AND text <> ''").select("doc_id", F.encode("text", "utf-8").alias("payload"))


def byte_rows(df: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """(key, pos, b) of every byte."""
    at = df.select(key, payload, F.explode(F.sequence(F.lit(0), F.octet_length(payload) - 1)).alias("pos"))
    return at.select(key, "pos", F.conv(F.hex(F.expr(f"substring({payload}, pos + 1, 1)")), 16, 10).cast("int").alias("b"))


def document_bytes(spark: SparkSession, d: str) -> DataFrame:
    return byte_rows(payloads(spark, d), "doc_id")


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """(xrgb): a bag of 24-bit colours."""
    return table(spark, d, "lineitem").select(F.expr("cast((l_partkey * 65793 + l_suppkey * 257 + l_linenumber) % 16777216 as int)").alias("xrgb"))


def colours(spark: SparkSession, d: str) -> DataFrame:
    """(object_id, run_id, xrgb): the valid exported colours; re-exported rows are one."""
    ok = " AND ".join(f"{c} BETWEEN 0 AND 255" for c in "rgb")
    o = table(spark, d, "colorfit_objects").filter(f"{ok} AND run_id IS NOT NULL")
    return o.select("object_id", "run_id", F.expr("r * 65536 + g * 256 + b").alias("xrgb")).distinct()


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, label, pos, v): 8 x 8 blocks of 64 values."""
    return table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))


def tiles(spark: SparkSession, d: str) -> DataFrame:
    """(tile_pos, tile): 8 x 8 tiles in key order, many of them equal or mirrored."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("tile_pos"), "p_size")
    return p.select("tile_pos", F.expr("transform(sequence(0, 63), i -> cast((p_size % 7 + (i % 8) * (p_size % 3) + (i div 8) * (p_size % 2)) % 5 as int))").alias("tile"))


def frames(spark: SparkSession, d: str) -> DataFrame:
    """(stream, event_id, ts, s): samples of streams, in order of ts; event_id is unique."""
    return table(spark, d, "events").select(F.col("event_type").alias("stream"), "event_id", "ts", F.expr("cast(floor(value * 100) as int)").alias("s"))


def palette(spark: SparkSession, d: str) -> DataFrame:
    """(idx, xrgb): 25 colours, one for each nation; a fixed table."""
    n = table(spark, d, "nation")
    return n.select(F.col("n_nationkey").cast("int").alias("idx"), F.expr("cast((n_nationkey * 7919 + n_regionkey * 104729 + 12345) * 37 % 16777216 as int)").alias("xrgb"))
