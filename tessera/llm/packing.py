"""Filling fixed-capacity containers with items: minimum bin slack over the histogram of sizes.

What matters for filling is how many items there are of each size, of which there are at most as many as the capacity has tokens. The histogram is summed
in Spark; the fill plan is made from it on the driver, whose work depends on the capacity and not on the rows: a container begins with
the largest size left, a bitset subset-sum program finds the multiset of remaining sizes that fills the rest closest to capacity, its counts are found by
backtracking, and the pattern is used for as many containers as the remaining counts allow. Items then find their container by their rank within
their size, by binary search in the plan. Ranks are made of salted parts, so that a size that a third of all items have is not ranked in one task; where the parts begin is
a prefix sum over their counts, which stays in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir

#: Parts of a size that are ranked apart.
SALTS = 64
#: More limits than this are an error: each one is a plan of its own.
MAX_PACKS = 100


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Multiset of sizes whose sum is as near to ``room`` as can be without going beyond; {size: times}.

    Sizes are taken in from the largest; the program ends early once the room is filled exactly.
    """
    mask = (1 << (room + 1)) - 1
    reach = 1
    trail: list[tuple[int, int, int]] = []
    for size in sorted((s for s, n in counts.items() if n > 0 and 0 < s <= room), reverse=True):
        before, left, part = reach, min(counts[size], room // size), 1
        while left > 0:  # 1, 2, 4, ... times, so that every number of times up to the count can be made
            take = min(part, left)
            reach |= (reach << (take * size)) & mask
            left -= take
            part *= 2
        trail.append((size, before, counts[size]))
        if reach >> room & 1:
            break
    target = reach.bit_length() - 1
    used: dict[int, int] = {}
    for size, before, n in reversed(trail):
        times = 0
        while not before >> target & 1:
            target -= size
            times += 1
        if times:
            used[size] = times
    return used


def fill_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, last rank + 1, times in a container, first container) of every use of a size in a pattern.

    Items of a size are used in order of rank, ``times`` of them in each container of the pattern.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    order = sorted(left, reverse=True)
    plan = []
    container = at = 0
    while at < len(order):
        top = order[at]
        if not left[top]:
            at += 1
            continue
        left[top] -= 1
        pattern = best_fill(left, capacity - top)
        left[top] += 1
        pattern[top] = pattern.get(top, 0) + 1
        times = min(left[s] // k for s, k in pattern.items())
        for s, k in pattern.items():
            plan.append((s, used[s], used[s] + times * k, k, container))
            used[s] += times * k
            left[s] -= times * k
        container += times
    return plan


def _container(spark: SparkSession, plan: list[tuple[int, int, int, int, int]]):
    """Column function (size, rank) -> container. The plan has a use for each size of each pattern, whose number the capacity bounds."""
    p = np.array(sorted(plan), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(p)

    @F.pandas_udf("long")
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        size, first, _, times, base = shared.value.T
        begin = np.searchsorted(size, np.arange(size.max() + 2))
        span = int(first.max()) + 1
        for rest, rank in batches:
            s, r = rest.to_numpy(np.int64), rank.to_numpy(np.int64)
            at = np.searchsorted(size * span + first, s * span + np.minimum(r, span - 1), "right") - 1
            at = np.maximum(at, begin[s])
            yield pd.Series(base[at] + (r - first[at]) // times[at])

    return find


def pack(items: DataFrame, limits: DataFrame, key: str, size: str, name: str = "pack_name", capacity: str = "capacity_tokens") -> DataFrame:
    """(name, key, piece, container, tokens): the container of every item for every limit.

    Only items above the capacity are split: into pieces of full capacity, each a container of its own, and a last piece that is packed like an item. Items of size zero or
    null take no space and get container 0. Keys may repeat, every row is packed; an empty table gives no rows; limits that are null or below one are left out.
    """
    spark = items.sparkSession
    ensure_checkpoint_dir(spark)
    rows = items.select(F.col(key).alias("k"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("n")).checkpoint()
    packs = [(r[0], int(r[1])) for r in limits.filter(f"{capacity} >= 1").select(name, capacity).orderBy(name).limit(MAX_PACKS + 1).collect()]
    if len(packs) > MAX_PACKS:
        raise ValueError(f"more than {MAX_PACKS} limits")
    outs = []
    for label, cap in packs:
        rest = F.pmod(F.col("n"), F.lit(cap))
        rest = F.when((rest == 0) & (F.col("n") > 0), F.lit(cap)).otherwise(rest)
        item = rows.select("k", "n", rest.alias("rest"), F.expr(f"cast(greatest((n - 1) div {cap}, 0) as int)").alias("full"), F.pmod(F.xxhash64("k", "n"), F.lit(SALTS)).cast("int").alias("salt"))
        parts = item.filter("rest > 0").groupBy("rest", "salt").agg(F.count("*").alias("c"), F.sum("full").alias("f"))
        counted = parts.groupBy("rest").agg(F.sum("c").alias("c"), F.sum("f").alias("f")).orderBy("rest").collect()  # one row for each size up to the capacity
        plan = fill_plan({r["rest"]: r["c"] for r in counted}, cap)
        empty = F.lit(0).cast("long")
        if not plan:
            outs.append(item.select(F.lit(label).alias(name), F.col("k").alias(key), F.lit(0).alias("piece"), empty.alias("container"), empty.alias("tokens")))
            continue
        last = max(p[4] + (p[2] - p[1]) // p[3] for p in plan)
        # full pieces are numbered behind all patterns: first those of the smallest rest, part by part
        heads_from, at_full = {}, last
        for r in counted:
            heads_from[r["rest"]] = at_full
            at_full += r["f"]
        base = F.broadcast(spark.createDataFrame(list(heads_from.items()), "rest long, headbase long"))
        wp = W.partitionBy("rest").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
        offs = parts.select("rest", "salt", F.coalesce(F.sum("c").over(wp), empty).alias("first"), F.coalesce(F.sum("f").over(wp), empty).alias("firstfull")).join(base, "rest")
        w = W.partitionBy("rest", "salt").orderBy("k", "n")
        ranked = item.filter("rest > 0").withColumn("r", F.row_number().over(w) - 1).withColumn("before", F.coalesce(F.sum("full").over(w.rowsBetween(W.unboundedPreceding, -1)), empty))
        placed = ranked.join(offs, ["rest", "salt"]).select("k", "full", "rest", (F.col("r") + F.col("first")).alias("rank"), (F.col("headbase") + F.col("firstfull") + F.col("before")).alias("fullbase"))
        tail = placed.withColumn("container", _container(spark, plan)("rest", "rank"))
        ends = tail.select("k", F.col("full").alias("piece"), "container", F.col("rest").alias("tokens"))
        heads = tail.filter("full > 0").select("k", F.explode(F.expr("sequence(0, full - 1)")).alias("piece"), "fullbase").select(
            "k", "piece", (F.col("fullbase") + F.col("piece")).alias("container"), F.lit(cap).cast("long").alias("tokens")
        )
        none = item.filter("rest = 0").select("k", F.lit(0).alias("piece"), empty.alias("container"), empty.alias("tokens"))
        outs.append(ends.unionByName(heads).unionByName(none).select(F.lit(label).alias(name), F.col("k").alias(key), "piece", "container", "tokens"))
    if not outs:
        return spark.createDataFrame([], f"{name} string, {key} {items.schema[key].dataType.simpleString()}, piece int, container long, tokens long")
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out


def usage(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """Containers, tokens and unused share of each pack."""
    c = packed.groupBy("pack_name", "container").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).filter("t > 0")
    agg = c.groupBy("pack_name").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    return agg.join(limits.select("pack_name", "capacity_tokens"), "pack_name").select(
        "pack_name", "capacity_tokens", "containers", "tokens", "fullest", F.expr("round(1 - tokens / (containers * capacity_tokens), 6)").alias("unused_share")
    )
