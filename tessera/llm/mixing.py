"""Mixing sources to target weights: complete epochs, then weighted sampling without replacement.

The total is given, or is the largest for which every source can reach its share with no record used more often than allowed. A source whose budget is more than its size is taken in
complete epochs first; the rest of its budget is chosen by Efraimidis-Spirakis sampling: each record has the exponential key
``-ln(u) / weight``, records are sorted by it within their source, and a prefix sum of their tokens is cut at the budget. The prefix sums are
made of ranges of keys, so that a source that holds a third of all rows is sorted in many tasks. The bounds of the ranges follow from the weights: with a share s of records of weight w, the share of keys
below x is the sum of ``s (1 - exp(-w x))``, which makes ranges of equal size whatever the weights are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir

#: Records of a source that are sorted together, about.
ROWS_PER_RANGE = 50_000


def quality_weight(score: Column) -> Column:
    """Weight in 0.05..1 from a quality score: of 0..1 as it is, up to 5 of five, up to 10 of ten, above of a hundred; missing and NaN ones weigh 0.5."""
    top = F.when(score <= 1, 1.0).when(score <= 5, 5.0).when(score <= 10, 10.0).otherwise(100.0)
    s = F.when(score.isNull() | F.isnan(score), F.lit(0.5)).otherwise(score / top)
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), s))


def _level(weight: Column) -> Column:
    """Weights by half octaves: some two thousand at most."""
    return F.round(F.log2(weight) * 2) / 2


def plan(records: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, size, budget, epochs, rest, ranges, levels) of every target source; one row each.

    A target source without tokens can't reach a share; it is left out of the total's bound and gets a budget of zero. With a ``total``, a source that can't reach its share of it
    is used as often as allowed.
    """
    by_level = records.groupBy("source", _level(F.col("weight")).alias("level")).agg(F.sum("tokens").alias("size"), F.count("*").alias("n"))
    size = by_level.groupBy("source").agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.collect_list(F.struct(F.pow(F.lit(2.0), "level").alias("w"), "n")).alias("levels"))
    targets = targets.select("source", "target_share", "max_repeats")
    t = targets.filter("source IS NOT NULL AND target_share > 0 AND max_repeats >= 1").join(size, "source", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    most = F.min(F.when(F.col("size") > 0, F.col("size") * F.col("max_repeats") / F.col("target_share"))).over(W.partitionBy(F.lit(1)))  # over the targets
    wanted = F.floor(F.col("target_share") * (most if total is None else F.lit(float(total))) + 1e-6)
    budget = F.when(F.col("size") > 0, F.least(wanted, F.col("size") * F.col("max_repeats"))).otherwise(0)
    epochs = F.when(F.col("size") > 0, F.least(F.floor(F.col("budget") / F.col("size")), F.col("max_repeats"))).otherwise(0).cast("long")
    t = t.withColumn("budget", budget).withColumn("epochs", epochs)
    rest = F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("size")).otherwise(0)
    ranges = F.ceil(F.coalesce("n", F.lit(0)) / ROWS_PER_RANGE).cast("long")
    return t.select("source", "target_share", "max_repeats", "size", "budget", "epochs", rest.alias("rest"), ranges.alias("ranges"), F.expr("transform(levels, x -> struct(x.w AS w, x.n / n AS share))").alias("levels"))


def mix(records: DataFrame, targets: DataFrame, seed: int = 42, total: int | None = None) -> DataFrame:
    """(id, source, tokens, times): the chosen records and how often each is used.

    ``records`` has id, source, tokens, weight; ``total`` is the number of tokens wanted, the largest that all shares allow if it is not given. Records without tokens, with a weight that is null, NaN or not above
    zero, and sources that are null or no target, are not chosen. Ties of keys are broken by id;
    the record at the cut is taken if more than half of it fits, so that the rest is missed by less than one record. Equal seeds give equal results; repeated rows are records of their own.
    """
    ensure_checkpoint_dir(records.sparkSession)
    rows = records.filter("tokens > 0 AND source IS NOT NULL AND weight > 0 AND NOT isnan(weight)").select("id", "source", "tokens", "weight").checkpoint()
    p = plan(rows, targets, total).checkpoint()  # as many rows as there are targets
    few = F.broadcast(p.select("source", "epochs", "rest", "ranges", "levels"))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11) + 0.5) / float(1 << 53)
    keyed = rows.join(few, "source").withColumn("key", -F.log(u) / F.col("weight"))
    below = F.expr("aggregate(levels, 0.0D, (a, x) -> a + x.share * (1 - exp(-x.w * key)))")  # grows with the key, and is about evenly spread
    keyed = keyed.withColumn("range", F.least(F.col("ranges") - 1, F.floor(F.col("ranges") * below)).cast("long")).drop("levels", "ranges")
    sums = keyed.groupBy("source", "range").agg(F.sum("tokens").alias("in_range"))  # one row for each range
    before = F.coalesce(F.sum("in_range").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bounds = sums.select("source", "range", before.alias("before"))
    w = W.partitionBy("source", "range").orderBy("key", "id").rowsBetween(W.unboundedPreceding, -1)
    placed = keyed.withColumn("own", F.coalesce(F.sum("tokens").over(w), F.lit(0))).join(bounds, ["source", "range"])
    extra = (F.col("before") + F.col("own") + F.col("tokens") / 2 <= F.col("rest")).cast("long")
    return placed.select("id", "source", "tokens", (F.col("epochs") + extra).alias("times")).filter("times > 0")


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """Target share and share really reached of every target source."""
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("used_tokens"), F.count("*").alias("records"), F.max("times").alias("most_times"))
    t = targets.join(used, "source", "left").select(
        "source", "target_share", "max_repeats", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("used_tokens", "records", "most_times"))
    )
    total = F.sum("used_tokens").over(W.partitionBy(F.lit(1)))
    return t.withColumn("reached_share", F.round(F.when(total > 0, F.col("used_tokens") / total).otherwise(0.0), 6))
