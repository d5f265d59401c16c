import itertools
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import mixing as X
from tessera.llm import packing as P


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), max_size=4), st.integers(0, 25))
def test_best_fill_is_best(counts, room):
    best = max(s for s in (sum(k * n for k, n in zip(counts, ns)) for ns in itertools.product(*(range(n + 1) for n in counts.values()))) if s <= room)
    used = P.best_fill(counts, room)
    assert sum(k * n for k, n in used.items()) == best and all(n <= counts[k] for k, n in used.items())


def _pack(spark, items, caps):
    df = spark.createDataFrame(items, "doc_id long, tokens long").withColumn("container", F.lit(7))
    limits = spark.createDataFrame(caps, "pack_name string, capacity_tokens int")
    return P.pack(df, limits, "doc_id", "tokens").collect()


def test_every_item_once_nothing_above_capacity(spark):
    r = random.Random(1)
    items = [(i, r.choice([3, 3, 3, 3, r.randrange(1, 90), 250])) for i in range(700)] + [(900, 0), (901, None), (902, 32), (902, 32), (903, 64), (904, 1000)]
    caps = [("a", 32), ("b", 100), ("none", None), ("zero", 0)]
    rows = _pack(spark, items, caps)
    assert {x["pack_name"] for x in rows} == {"a", "b"}
    for name, cap in caps[:2]:
        mine = [x for x in rows if x["pack_name"] == name]
        fill, pieces = Counter(), defaultdict(list)
        for x in mine:
            fill[x["container"]] += x["tokens"]
            pieces[x["doc_id"]].append((x["piece"], x["tokens"]))
        assert max(fill.values()) <= cap
        want = Counter()
        for k, n in items:
            want[k] += n or 0
        assert {k: sum(t for _, t in v) for k, v in pieces.items()} == dict(want)
        for k, n in items:
            if k != 902:
                assert sorted(p for p, _ in pieces[k]) == list(range(max(1, -(-(n or 0) // cap))))
                assert all(t == cap for p, t in sorted(pieces[k])[:-1])
        total = sum(n or 0 for _, n in items)
        assert sum(t > 0 for t in fill.values()) <= -(-total // cap) * 1.02 + 1
    assert _pack(spark, [], caps) == []
    assert _pack(spark, items, [("none", None)]) == []


def test_hot_size(spark):
    rows = _pack(spark, [(i, 10) for i in range(3000)], [("a", 35)])
    assert Counter(Counter(x["container"] for x in rows).values()) == {3: 1000}


def test_shares_repeats_and_total(spark):
    r = random.Random(2)
    recs = [(i, s, r.randrange(1, 40), w) for i, (s, w) in enumerate((s, w) for s, n in (("big", 3000), ("mid", 600), ("small", 90)) for w in [0.05, 1.0, 0.5] * (n // 3))]
    recs += [(9001, None, 5, 1.0), (9002, "other", 5, 1.0), (9003, "big", 0, 1.0), (9004, "big", 5, None), (9005, "big", 5, float("nan"))]
    df = spark.createDataFrame(recs, "id long, source string, tokens long, weight double").withColumn("range", F.lit("x"))
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 5), ("gone", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    sizes = Counter()
    for _, s, t, w in recs:
        if w and w == w:
            sizes[s] += t
    total = min(sizes[s] * m / q for s, q, m in (("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 5)))
    rows = X.mix(df, targets).collect()
    used, times = Counter(), defaultdict(list)
    for x in rows:
        used[x["source"]] += x["tokens"] * x["times"]
        times[x["source"]].append(x["times"])
    assert set(used) == {"big", "mid", "small"} and max(times["mid"]) <= 2 and max(times["small"]) <= 5 and max(times["big"]) == 1
    assert all(abs(used[s] - q * total) <= 40 for s, q in (("big", 0.5), ("mid", 0.3), ("small", 0.1)))
    assert max(times["small"]) - min(times["small"]) <= 1 and len(times["small"]) == 90  # complete epochs come first
    assert sorted(map(tuple, X.mix(df, targets).collect())) == sorted(map(tuple, rows))
    few = X.mix(df, targets, total=2000).collect()
    got = Counter()
    for x in few:
        got[x["source"]] += x["tokens"] * x["times"]
    assert abs(got["big"] - 1000) <= 40 and abs(got["small"] - 200) <= 40
    heavy = Counter(recs[x["id"]][3] for x in few if x["source"] == "big")
    assert heavy[1.0] > 4 * heavy[0.05]
    assert X.mix(df.limit(0), targets).count() == 0 and X.mix(df, targets.limit(0)).count() == 0
    shares = {x["source"]: x for x in X.shares(X.mix(df, targets), targets.filter("source IS NOT NULL")).collect()}
    assert shares["gone"]["used_tokens"] == 0 and abs(sum(x["reached_share"] for x in shares.values()) - 1) < 1e-4


def test_prefix_sums_over_many_ranges_are_those_of_one_sort(spark, monkeypatch):
    r = random.Random(3)
    recs = [(i, "s", r.randrange(1, 9), r.choice([0.05, 0.05, 0.05, 1.0])) for i in range(4000)]
    df = spark.createDataFrame(recs, "id long, source string, tokens long, weight double")
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    one = sorted(x["id"] for x in X.mix(df, targets, total=3000).collect())
    monkeypatch.setattr(X, "ROWS_PER_RANGE", 50)
    assert sorted(x["id"] for x in X.mix(df, targets, total=3000).collect()) == one
    p = X.plan(df, targets, 3000).first()
    assert p["ranges"] == 80
    # the ranges hold about as many rows each, although most weights are the least
    below = F.expr("aggregate(levels, 0.0D, (a, x) -> a + x.share * (1 - exp(-x.w * key)))")
    k = df.withColumn("key", -F.log((F.shiftrightunsigned(F.xxhash64(F.lit(42), "id"), 11) + 0.5) / float(1 << 53)) / F.col("weight")).crossJoin(X.plan(df, targets, 3000).select("levels"))
    assert max(x["count"] for x in k.groupBy(F.floor(below * 80).alias("g")).count().collect()) < 150


@pytest.mark.parametrize("score,weight", [(0.7, 0.7), (4.5, 0.9), (70.0, 0.7), (8.0, 0.8), (None, 0.5), (float("nan"), 0.5), (-1.0, 0.05)])
def test_quality_weight(spark, score, weight):
    assert abs(spark.createDataFrame([(score,)], "s double").select(X.quality_weight(F.col("s"))).first()[0] - weight) < 1e-9
