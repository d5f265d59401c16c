"""Byte and array primitives: padding, words, prefix sums, modular deltas, interleaving.

Array forms are column expressions; long forms are rows with a key, a position and a value, and use one window per operator. Nulls stay null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fill_up_to_multiple(a: Column, n: int, value=0) -> Column:
    """Array padded at its end to a multiple of n; an empty one stays empty."""
    short = F.pmod(-F.size(a), F.lit(n))
    return F.when(F.size(a) == 0, a).otherwise(F.concat(a, F.array_repeat(F.lit(value), short)))


def pad_binary(b: Column, n: int) -> Column:
    """Bytes padded with zeros to a multiple of n; empty ones stay empty."""
    size = F.octet_length(b)
    return F.concat(b, F.unhex(F.repeat(F.lit("00"), F.pmod(-size, F.lit(n)))))


def divide_by(a: Column, n: int) -> Column:
    return F.transform(a, lambda x: F.floor(x / n).cast("long"))


def prepend_value(a: Column, value: Column, width: int) -> Column:
    """Little-endian bytes of a value in front of an array of bytes."""
    return F.concat(F.array(*(F.shiftright(value, 8 * i).bitwiseAND(F.lit(255)) for i in range(width))), a)


def words(df: DataFrame, keys: list[str], pos: str, value: str, width: int, out: str = "word") -> DataFrame:
    """Little-endian words of ``width`` bytes: (keys, pos, out). Parts whose size isn't a multiple give a last, shorter word."""
    at = F.floor(F.col(pos) / width).cast("int")
    part = F.col(value).cast("long") * F.pow(F.lit(256.0), F.pmod(F.col(pos), F.lit(width))).cast("long")
    return df.groupBy(*keys, at.alias(pos)).agg(F.sum(part).alias(out))


def pack_bits(df: DataFrame, keys: list[str], pos: str, value: str, bits: int, out: str = "b") -> DataFrame:
    """Bytes of indices of 1, 2 or 4 bits, the first index in the low bits."""
    k = 8 // bits
    part = F.col(value).cast("long") * F.pow(F.lit(2.0), F.pmod(F.col(pos), F.lit(k)) * bits).cast("long")
    return df.groupBy(*keys, F.floor(F.col(pos) / k).cast("int").alias(pos)).agg(F.sum(part).alias(out))


def start_indices(df: DataFrame, keys: list[str], order: str, length: str, out: str = "start", slot: Column | None = None) -> DataFrame:
    """Exclusive prefix sums of lengths. With ``slot``, hot keys are split, see ``running``."""
    if slot is not None:
        return running(df, keys, order, length, slot).withColumnRenamed("_before", out).drop("_first", "_last")
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(length).over(w), F.lit(0)))


def delta_encode(df: DataFrame, keys: list[str], order: str, value: str, bits: int, out: str = "delta") -> DataFrame:
    """The first value as it is, then differences modulo 2^bits."""
    w = W.partitionBy(*keys).orderBy(order)
    return df.withColumn(out, F.pmod(F.col(value) - F.lag(value, 1, 0).over(w), F.lit(1 << bits)))


def delta_decode(df: DataFrame, keys: list[str], order: str, delta: str, bits: int, out: str = "value") -> DataFrame:
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(out, F.pmod(F.sum(F.col(delta).cast("long")).over(w), F.lit(1 << bits)))


def running(df: DataFrame, keys: list[str], order: str, value: str, slot: Column) -> DataFrame:
    """Adds ``_before`` (sum of the earlier values), ``_first`` (first value) and ``_last`` (the value before) of each row within its keys.

    A key may hold any share of the rows: its rows are cut into ranges by ``slot``, a column that grows with ``order``. Sums, first and last values of the ranges, one row for each, are carried from range to range,
    and the rows of a range are sorted on their own.
    """
    df = df.withColumn("_slot", slot)
    v = F.col(value).cast("long")
    ends = df.groupBy(*keys, "_slot").agg(F.sum(v).alias("_s"), F.min(F.struct(F.col(order).alias("o"), v.alias("v"))).alias("_lo"), F.max(F.struct(F.col(order).alias("o"), v.alias("v"))).alias("_hi"))
    w = W.partitionBy(*keys).orderBy("_slot")
    until = w.rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_slot").alias("_sl"), F.coalesce(F.sum("_s").over(until), F.lit(0)).alias("_c"),
        F.first("_lo.v").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("_first"), F.lag("_hi.v").over(w).alias("_prev"),
    )
    wi = W.partitionBy(*keys, "_slot").orderBy(order)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_slot").eqNullSafe(F.col("_sl"))]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    own = df.withColumn("_o", F.coalesce(F.sum(v).over(wi.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_l", F.lag(v).over(wi))
    j = own.join(carried, cond)
    return j.withColumn("_before", F.col("_o") + F.col("_c")).withColumn("_last", F.coalesce("_l", "_prev")).drop("_slot", "_sl", "_o", "_l", "_c", "_prev", *(f"_k{i}" for i in range(len(keys))))


def delta_image(df: DataFrame, keys: list[str], order: str, value: str, bits: int, out: str = "diff", slot: Column | None = None) -> DataFrame:
    """Stateful frame difference whose state is the last difference: ``x1 - x2 - ... - xn`` for frame n > 1, modulo 2^bits. With ``slot``, hot keys are split, see ``running``."""
    v = F.col(value).cast("long")
    if slot is not None:
        r = running(df, keys, order, value, slot)
        return r.withColumn(out, F.pmod(F.col("_first") * 2 - F.col("_before") - v, F.lit(1 << bits))).drop("_before", "_first", "_last")
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(out, F.pmod(F.first(v).over(w) * 2 - F.sum(v).over(w), F.lit(1 << bits)))


def delta_image_successive(df: DataFrame, keys: list[str], order: str, value: str, bits: int, out: str = "diff", slot: Column | None = None) -> DataFrame:
    """Difference of successive frames, the first as it is."""
    if slot is not None:
        r = running(df, keys, order, value, slot)
        return r.withColumn(out, F.pmod(F.col(value) - F.coalesce("_last", F.lit(0)), F.lit(1 << bits))).drop("_before", "_first", "_last")
    return delta_encode(df, keys, order, value, bits, out)


def interleave(df: DataFrame, keys: list[str], set_no: str, pos: str, n_sets: int, out: str = "at") -> DataFrame:
    """Place of every value when the sets are interleaved: a0 b0 a1 b1 ..."""
    return df.withColumn(out, F.col(pos) * n_sets + F.col(set_no))
