import random

import numpy as np
import pytest

from tessera.llm import similarity_clusters as C


def _brute(points, near=24):
    """Least id of the component of every point; points are (grp, r, g, b, id)."""
    xyz = np.array([p[1:4] for p in points])
    grp = np.array([p[0] for p in points])
    d = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
    i, j = np.nonzero((d <= near * near) & (grp[:, None] == grp[None]))
    label = C.components(len(points), i, j)
    ids = np.array([p[4] for p in points])
    return {p[4]: int(ids[label == label[k]].min()) for k, p in enumerate(points)}


def _points(seed, n, groups=3):
    r = random.Random(seed)
    out = []
    for g in range(groups):
        mids = [[r.randrange(256) for _ in range(3)] for _ in range(r.randrange(1, 9))]
        for _ in range(n):
            m = r.choice(mids)
            out.append((g, *(min(255, max(0, int(r.gauss(x, 7)))) for x in m), len(out) + 100))
    # chains whose steps are just below, at and above the limit, and between near and far
    for g, step in ((10, 23), (11, 24), (12, 25), (13, 31), (14, 32)):
        out += [(g, k * step, 128, 9, len(out) + 100 + k) for k in range(8)]
    out += [(15, 3 * k, 4 * k, 0, 5000 + k) for k in range(60)]
    return out


@pytest.mark.parametrize("exact", [False, True])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clusters_are_those_of_all_pairs(spark, seed, exact):
    pts = _points(seed, 250)
    df = spark.createDataFrame(pts, "grp long, r int, g int, b int, id long").repartition(5)
    labels = C.cluster_labels(df, exact=exact)
    got = {x["id"]: x["first_id"] for x in C.with_labels(df, labels).collect()}
    assert got == _brute(pts)


def test_links_between_near_and_far_are_split(spark):
    pts = [(1, 10, 10, 10, 1), (1, 38, 10, 10, 2), (1, 66, 10, 10, 3), (1, 70, 10, 10, 4)]  # 28 apart
    df = spark.createDataFrame(pts, "grp long, r int, g int, b int, id long")
    first = {x["id"]: x["first_id"] for x in C.with_labels(df, C.cluster_labels(df)).collect()}
    assert first == {1: 1, 2: 2, 3: 3, 4: 3}


def test_recall_of_the_bands():
    sig = C.signatures(48, 4)
    r = np.random.default_rng(1)
    v = np.unique(r.integers(0, 32768, 6000))
    xyz = np.stack([v // 1024, v // 32 % 32, v % 32], 1)
    lo = xyz * 8
    hi = lo + 7
    g = np.zeros(len(v), int)
    a = {(x, y) for x, y, d, _ in zip(*C.linked(xyz, g, v, lo, hi, None, 32, 4)) if d <= 576}
    b = {(x, y) for x, y, d, _ in zip(*C.linked(xyz, g, v, lo, hi, sig, 32, 4)) if d <= 576}
    assert b <= a and len(b) >= 0.9999 * len(a) > 1000
    assert C.least_jaccard(24, 4) > 0.25 and (1 - C.least_jaccard(24, 4)) ** 48 < 1e-6


def test_full_cube_in_one_group():
    v = np.arange(32768)
    import pandas as pd

    x, y, z = v // 1024 * 8, v // 32 % 32 * 8, v % 32 * 8
    box = (x << 40) + (y << 32) + (z << 24) + ((x + 7) << 16) + ((y + 7) << 8) + z + 7
    nodes = pd.DataFrame({"grp": 1, "v": v, "box": box, "first_id": v + 5, **{f"w{k}": -1 for k in range(8)}})
    got = C.label_groups(nodes, C.signatures(48, 4), 24, 32, 4)
    assert set(got["first_id"]) == {5}


def test_rows(spark):
    rows = [(1, 1, 5, 5, 5, "x"), (1, 1, 5, 5, 5, "y"), (2, 1, 6, 6, 6, "x"), (3, 1, None, 6, 6, "x"), (4, 1, 300, 6, 6, "x"), (5, None, 6, 6, 6, "x"), (6, 2, 6, 6, 6, "x"), (7, 1, -1, 6, 6, "x"), (8, 1, 200, 6, 6, None)]
    df = spark.createDataFrame(rows, "object_id long, run_id long, r int, g int, b int, v string")
    assert [tuple(x) for x in C.cluster_pairs(df).collect()] == [(1, 2)]
    got = {x["first_object_id"]: (x["size"], list(x["typical_ids"])) for x in C.describe_clusters(df).collect()}
    assert got == {1: (2, [1, 2]), 6: (1, [6]), 8: (1, [8])}
    assert C.cluster_pairs(df.limit(0)).count() == 0 and C.describe_clusters(df.limit(0)).count() == 0
