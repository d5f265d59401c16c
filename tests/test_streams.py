import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import temporal as T
from tessera.streaming import stateful as S


def live(spark, df, folder, parts=4):
    df.repartition(parts).write.parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return spark.table(name)


def test_interval_map(spark, tmp_path):
    from tessera.operators import intervals as I

    r = random.Random(1)
    df = spark.createDataFrame([(r.randrange(3), a, a + r.randrange(1, 4)) for a in (float(r.randrange(100)) for _ in range(200))], "k long, a double, b double")
    out = run(spark, S.interval_changes(live(spark, df, tmp_path / "in"), "k", "a", "b"), "changes", tmp_path).collect()
    last = {}
    for x in out:
        last[x["key"]] = max(last.get(x["key"], 0), x["version"])
    got = {kind: sorted((x["key"], x["start_ms"], x["end_ms"]) for x in out if x["kind"] == kind and x["version"] == last[x["key"]]) for kind in ("gap", "period")}
    assert got["gap"] == sorted(map(tuple, I.gaps(df, "k", "a", "b").collect())) and got["period"] == sorted(map(tuple, I.periods(df, "k", "a", "b").collect()))


def test_deltas_windows_and_counts(spark, tmp_path):
    r = random.Random(2)
    df = spark.createDataFrame([(k, i, r.randrange(400), f"2024-01-01 00:{i % 60:02d}:00") for k in "ab" for i in range(40)], "k string, n long, v int, t string").withColumn("t", F.col("t").cast("timestamp"))
    d = run(spark, S.frame_deltas(live(spark, df, tmp_path / "a", 1), "k", "n", "v", 16), "deltas2", tmp_path)
    from tessera.operators import arrays as A

    want = sorted(tuple(x) for x in A.delta_image(df, ["k"], "n", "v", 16).select("k", "n", "diff").collect())
    assert sorted(tuple(x) for x in d.collect()) == want
    w = run(spark, S.repackage_stream(live(spark, df, tmp_path / "b", 1), "k", "n", "v", 150.5, 8), "windows", tmp_path)
    full = [tuple(x) for x in T.repackage(df, "k", ["n"], "v", 150.5, 8).collect()]
    assert {tuple(x) for x in w.collect()} <= set(full) and len(full) - w.count() <= 2  # the rests wait for more
    c = run(spark, S.windowed_counts(live(spark, df, tmp_path / "c"), "t", "k"), "counts", tmp_path)
    assert c.count() == 0 or c.agg(F.sum("n")).first()[0] <= 80


def test_repeats_are_measured_from_the_last_that_stayed(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.0, 4.0, 8.0, 12.0, 13.0, 30.0])] + [("b", 0, None), ("b", 1, 5.0), ("b", 2, None), ("b", 3, 5.5)], "k string, n int, v double").repartition(3)
    got = sorted((x["k"], x["n"]) for x in T.drop_repeats(df, ["k"], ["n"], "v", 100.0).collect())
    assert got == [("a", 0), ("a", 3), ("a", 5), ("b", 0), ("b", 1), ("b", 2)]
    assert T.drop_repeats(df.limit(0), ["k"], ["n"], "v", 100.0).count() == 0


def test_joins_in_time(spark):
    r = random.Random(3)
    pts = [(r.choice("ab"), float(r.randrange(60)), i) for i in range(80)] + [("a", None, 900)]
    iv = [(r.choice("ab"), float(a), float(a + r.randrange(-1, 25)), i) for i, a in enumerate(r.randrange(60) for _ in range(40))] + [("a", None, 3.0, 901), ("b", 3.0, None, 902)]
    p = spark.createDataFrame(pts, "k string, t double, p int")
    i = spark.createDataFrame(iv, "k string, s double, e double, i int")
    want = sorted((a[2], b[3]) for a in pts for b in iv if a[0] == b[0] and None not in (a[1], b[1], b[2]) and b[1] <= a[1] < b[2])
    for slot in (1.0, 7.0, 100.0):
        assert sorted((x["p"], x["i"]) for x in T.active_intervals(p, i, "k", "t", "s", "e", slot).collect()) == want
    facts = spark.createDataFrame([(k, t, v) for k, t, v in pts if t is not None and v % 3 == 0], "k string, t double, v int")
    got = {x["p"]: x["v"] for x in T.as_of(p.filter("t IS NOT NULL"), facts, "k", "t", "v").collect()}
    for k, t, n in pts:
        if t is not None:
            best = max(((ft, fv) for fk, ft, fv in pts if fk == k and ft is not None and fv % 3 == 0 and ft <= t), default=(0, None))
            assert got[n] == best[1]


def test_injection_is_that_of_a_scan(spark):
    r = random.Random(4)
    frames = [("a", i, i * 0.5) for i in range(40)]
    starts = sorted(r.choice([0.0, 1.2, 1.2, 3.0, 9.9, 19.0, 25.0]) for _ in range(12))
    f = spark.createDataFrame(frames, "k string, n long, t double")
    c = spark.createDataFrame([("a", i, s) for i, s in enumerate(starts)], "k string, c long, s double")
    want, nxt = [], 0
    for _, n, t in frames:
        if nxt < len(starts) and t >= starts[nxt]:
            want.append((nxt, n))
            nxt += 1
    assert sorted((x["c"], x["n"]) for x in T.inject(f, c, "k", "n", "t", "c", "s").collect()) == want


def test_repackager():
    r = T.Repackager(367.5, 16)
    out = [r.push(100) for _ in range(50)]
    sizes = [x for x in out if x]
    assert all(x % 16 == 0 for x in sizes) and abs(sum(sizes) / len(sizes) - 367.5) < 16
    left = r.buffered
    assert r.flush() == left + -left % 16 and r.flush() is None
    with pytest.raises(TypeError):
        T.Repackager()
