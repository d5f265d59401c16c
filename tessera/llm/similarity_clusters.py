"""Grouping records into similarity clusters: MinHash bands, exact Jaccard, connected components, medoid splits.

A record is a point with three coordinates in 0..255 inside a group (a colour of a run). Points are first pre-aggregated to voxels of 8 x 8 x 8,
of which a group has at most 32768 whatever its number of rows, so that a group's voxels, but never its rows, are worked on in one task. The set that stands for a voxel holds all
lattice voxels of the cube of half width ``reach`` around it, so that near voxels have similar sets and their exact
Jaccard similarity has the closed form ``i / (2 s^3 - i)`` with ``i = prod(s - |d|)``, ``s = 2 reach + 1``.

1. MinHash: ``bands`` independent hashes of each set. Signatures depend on the voxel alone; they form a table of 32768 rows that is made once and broadcast (6 MB).
2. Voxels of a group with an equal hash in a band are candidates. Those whose exact Jaccard similarity and whose boxes allow points less than ``far`` apart are linked.
3. Connected components of the links. A component is loose if it reaches beyond ``near / 2`` from its highest-degree medoid; a tight one has no two points more than ``near`` apart.
4. Loose components are split around medoids: the voxel with the most links takes its free neighbours, and so on. Pieces are joined again only by links at most ``near`` long: links that the boxes prove,
   and those that a check point by point proves; a voxel has at most 512 places, kept as bits. Links between ``near`` and ``far`` hold nothing together.

A pair of voxels with points at most ``near`` = 24 apart has a similarity of at least 0.25; the bands miss it with a probability of at most 1e-6. ``exact=True`` looks up all neighbours instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VOXEL = 8
_AXIS = 256 // VOXEL
#: Voxels that are worked on together; whole groups, so that it may be exceeded by one group.
BATCH = 16_384


def jaccard(dx, dy, dz, reach: int):
    """Jaccard similarity of the cubes of two voxels that lie (dx, dy, dz) apart."""
    s = 2 * reach + 1
    inter = np.maximum(s - np.abs(dx), 0) * np.maximum(s - np.abs(dy), 0) * np.maximum(s - np.abs(dz), 0)
    return inter / (2 * s**3 - inter)


def least_jaccard(near: float, reach: int) -> float:
    """Smallest Jaccard similarity of voxels that hold points at most ``near`` apart."""
    best = 1.0
    top = int(near // VOXEL) + 1
    for dx in range(top + 1):
        for dy in range(dx + 1):
            for dz in range(dy + 1):
                least = sum(max(0, VOXEL * (d - 1) + 1) ** 2 for d in (dx, dy, dz))
                if least <= near * near:
                    best = min(best, float(jaccard(dx, dy, dz, reach)))
    return best


def signatures(bands: int, reach: int, seed: int = 7) -> np.ndarray:
    """MinHash of every voxel's set in each band: the number of the lattice voxel with the least random rank in its cube."""
    rng = np.random.default_rng(seed)
    side = _AXIS + 2 * reach
    out = np.empty((_AXIS**3, bands), np.int32)
    for b in range(bands):
        ranks = rng.permutation(side**3).astype(np.int32).reshape(side, side, side)
        for axis in range(3):
            windows = np.lib.stride_tricks.sliding_window_view(ranks, 2 * reach + 1, axis)
            ranks = windows.min(-1)
        out[:, b] = ranks.reshape(-1)
    return out


def voxels(points: DataFrame) -> DataFrame:
    """One row per group and occupied voxel: grp, v, box, first_id and the occupied places as eight 64-bit words.

    box packs the least and largest r, g, b in 48 bits. All are aggregates that combine before the shuffle.
    """
    v = F.expr("cast(shiftright(r, 3) * 1024 + shiftright(g, 3) * 32 + shiftright(b, 3) as int)")
    words = [F.expr(f"bit_or(CASE WHEN (r & 7) = {k} THEN shiftleft(1L, (g & 7) * 8 + (b & 7)) ELSE 0L END)").alias(f"w{k}") for k in range(VOXEL)]
    agg = points.withColumn("v", v).groupBy("grp", "v")
    rows = agg.agg(*(f(c).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "rgb"), F.min("id").alias("first_id"), *words)
    box = F.expr("".join(f"shiftleft(cast({c} as bigint), {40 - 8 * i}) + " for i, c in enumerate(("lor", "log", "lob", "hir", "hig")))[:-3] + " + hib")
    return rows.select("grp", "v", box.alias("box"), "first_id", *(f"w{k}" for k in range(VOXEL)))


def linked(xyz: np.ndarray, grp: np.ndarray, v: np.ndarray, lo: np.ndarray, hi: np.ndarray, sig: np.ndarray | None, far: float, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, least, most) of the linked voxels: indices and squared least and largest distances of their boxes. Without signatures, all neighbours are looked up.

    Links are kept as one flag for each voxel and offset, so that a pair that meets in many bands takes no more room.
    """
    n, r = len(v), int(far // VOXEL) + 1
    side = 2 * r + 1
    found = np.zeros((n, side**3), bool)
    shift = np.stack(np.meshgrid(*[np.arange(-r, r + 1)] * 3, indexing="ij"), -1).reshape(-1, 3)
    least = (np.maximum(VOXEL * (np.abs(shift) - 1) + 1, 0) * (shift != 0)) ** 2
    can = least.sum(1) < far * far
    s = 2 * reach + 1
    if sig is None:
        at = grp.astype(np.int64) * _AXIS**3 + v
        for k in np.nonzero(can)[0]:
            to = xyz + shift[k]
            inside = ((to >= 0) & (to < _AXIS)).all(1)
            code = at + (shift[k] * (_AXIS**2, _AXIS, 1)).sum()
            j = np.minimum(np.searchsorted(at, code), n - 1)
            found[:, k] = inside & (at[j] == code)
    else:
        bands = sig.shape[1]
        key = ((grp.astype(np.int64)[:, None] * bands + np.arange(bands)) << 20 | sig[v]).reshape(-1)
        order = np.argsort(key, kind="stable")
        key, node = key[order], order // bands
        left = np.arange(len(key) - 1)
        step = 1
        sim = jaccard(*shift.T, reach)
        floor = sim[can].min() if can.any() else 1.0
        while len(left):
            left = left[left + step < len(key)]
            left = left[key[left] == key[left + step]]
            a, b = node[left], node[left + step]
            d = xyz[b] - xyz[a]
            ok = (np.abs(d) <= r).all(1)
            code = ((d[ok] + r) * (side * side, side, 1)).sum(1)
            ok2 = (sim[code] >= floor) & can[code]  # exact Jaccard similarity
            found[a[ok][ok2], code[ok2]] = True
            step += 1
    a, k = np.nonzero(found)
    at = grp.astype(np.int64) * _AXIS**3 + v
    b = np.searchsorted(at, at[a] + (shift[k] * (_AXIS**2, _AXIS, 1)).sum(1))
    keep = a < b
    a, b = a[keep], b[keep]
    gap = np.maximum(0, np.maximum(lo[b] - hi[a], lo[a] - hi[b]))
    span = np.maximum(hi[b] - lo[a], hi[a] - lo[b])
    least, most = (gap * gap).sum(1), (span * span).sum(1)
    keep = least < far * far
    return a[keep], b[keep], least[keep], most[keep]


def touching(lo_a: np.ndarray, bits_a: np.ndarray, lo_b: np.ndarray, bits_b: np.ndarray, near: float) -> bool:
    """Whether two voxels hold points at most ``near`` apart; bits are the occupied places of a voxel, one word for each r, ``lo`` is the corner of its box."""

    def points(lo: np.ndarray, bits: np.ndarray) -> np.ndarray:
        at = np.nonzero(np.unpackbits(bits.astype("<i8").view(np.uint8), bitorder="little"))[0]
        return np.stack([at >> 6, at >> 3 & 7, at & 7], 1) + lo // VOXEL * VOXEL

    d = points(lo_a, bits_a)[:, None] - points(lo_b, bits_b)[None]
    return bool(((d * d).sum(2) <= near * near).any())


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of the component of each of n nodes: labels are hooked and shortened until they stay."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            short = new[new]
            if (short == new).all():
                break
            new = short
        if (new == label).all():
            return label
        label = new


def split_loose(n: int, lo: np.ndarray, hi: np.ndarray, bits: np.ndarray, a: np.ndarray, b: np.ndarray, least: np.ndarray, most: np.ndarray, near: float) -> np.ndarray:
    """Cluster of each voxel: components of the links, of which the loose ones are split around highest-degree medoids."""
    label = components(n, a, b)
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    order = np.lexsort((np.arange(n), -degree, label))
    first = np.ones(n, bool)
    first[1:] = label[order][1:] != label[order][:-1]
    medoid = np.empty(n, int)
    medoid[label[order][first]] = order[first]
    mid = ((lo + hi) / 2)[medoid[label]]
    reach = np.sqrt((np.maximum(np.abs(lo - mid), np.abs(hi - mid)) ** 2).sum(1))
    wide = np.zeros(n, bool)
    wide[label[reach > near / 2]] = True
    loose = wide[label]
    if not loose.any():
        return label
    sure = most <= near * near
    # pieces around medoids, over the links that the boxes prove
    i, j = a[sure & loose[a]], b[sure & loose[a]]
    src, dst = np.concatenate([i, j]), np.concatenate([j, i])
    by = np.argsort(src, kind="stable")
    links, start = dst[by].tolist(), np.searchsorted(src[by], np.arange(n + 1)).tolist()
    links_of = np.bincount(src, minlength=n)
    piece = np.where(loose, -1, np.arange(n)).tolist()
    at = np.nonzero(loose)[0]
    for x in at[np.lexsort((at, -links_of[at]))].tolist():
        if piece[x] < 0:
            piece[x] = x
            for y in links[start[x] : start[x + 1]]:
                if piece[y] < 0:
                    piece[y] = x
    # pieces that a proven link crosses are one cluster
    root = components(n, np.concatenate([i, np.arange(n)]), np.concatenate([j, np.array(piece)]))
    tight = ~loose[a]
    root = components(n, np.concatenate([a[tight], np.arange(n)]), np.concatenate([b[tight], root]))
    # what the boxes leave open is decided point by point
    open_ = np.nonzero(~sure & loose[a] & (least <= near * near) & (root[a] != root[b]))[0]
    up = {}

    def find(x: int) -> int:
        while (y := up.get(x, x)) != x:
            x = y
        return x

    for k in open_[np.argsort(least[open_], kind="stable")].tolist():
        x, y = find(int(root[a[k]])), find(int(root[b[k]]))
        if x != y and touching(lo[a[k]], bits[a[k]], lo[b[k]], bits[b[k]], near):
            up[max(x, y)] = min(x, y)
    if up:
        root = np.array([find(x) for x in root.tolist()])
    return root


def label_groups(nodes: pd.DataFrame, sig: np.ndarray | None, near: float, far: float, reach: int) -> pd.DataFrame:
    """(grp, v, label, first_id) of whole groups of voxels, sorted by grp and v."""
    g, v = pd.factorize(nodes["grp"])[0], nodes["v"].to_numpy(np.int64)
    box = nodes["box"].to_numpy(np.int64)
    lo, hi = (np.stack([box >> s & 255 for s in at], 1) for at in ((40, 32, 24), (16, 8, 0)))
    xyz = np.stack([v // _AXIS**2, v // _AXIS % _AXIS, v % _AXIS], 1)
    edges = linked(xyz, g, v, lo, hi, sig, far, reach)
    root = split_loose(len(v), lo, hi, nodes[[f"w{k}" for k in range(VOXEL)]].to_numpy(), *edges, near)
    first = nodes["first_id"].groupby(root).transform("min")
    return pd.DataFrame({"grp": nodes["grp"], "v": v.astype("int32"), "label": v[root].astype("int32"), "first_id": first})


def cluster_labels(points: DataFrame, near: float = 24, far: float = 32, bands: int = 48, reach: int = 4, exact: bool = False) -> DataFrame:
    """(grp, v, label, first_id): the cluster of every occupied voxel of a group.

    ``points`` has grp, r, g, b, id, with coordinates in 0..255. Points at most ``near`` apart share a cluster; clusters are more than that apart.
    A group has at most 32768 voxels, so that a task holds a bounded number of nodes, whatever share of the rows its group has.
    """
    nodes = voxels(points)
    shared = None if exact else points.sparkSession.sparkContext.broadcast(signatures(bands, reach))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sig = shared.value if shared else None
        held: list[pd.DataFrame] = []
        size = 0
        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size > BATCH:
                held = [pd.concat(held, ignore_index=True)]
                cut = int(np.searchsorted(held[0]["grp"].to_numpy(), held[0]["grp"].iloc[-1]))  # the last group may go on
                if cut:
                    yield label_groups(held[0].iloc[:cut].reset_index(drop=True), sig, near, far, reach)
                    held = [held[0].iloc[cut:]]
                    size = len(held[0])
        if size:
            yield label_groups(pd.concat(held, ignore_index=True), sig, near, far, reach)

    together = nodes.repartition("grp").sortWithinPartitions("grp", "v")
    return together.mapInPandas(run, "grp long, v int, label int, first_id long")


def colour_points(objects: DataFrame) -> DataFrame:
    """Valid colours: rows with a channel that is null or outside 0..255, or without a run, belong to no cluster."""
    ok = " AND ".join(f"{c} BETWEEN 0 AND 255" for c in "rgb")
    return objects.filter(f"{ok} AND run_id IS NOT NULL AND object_id IS NOT NULL").select(F.col("run_id").alias("grp"), "r", "g", "b", F.col("object_id").alias("id"))


def with_labels(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Points with their cluster; a voxel that holds a large share of all rows is split by adaptive skew handling."""
    v = F.expr("cast(shiftright(r, 3) * 1024 + shiftright(g, 3) * 32 + shiftright(b, 3) as int)")
    return points.withColumn("v", v).join(labels, ["grp", "v"])


def cluster_pairs(objects: DataFrame) -> DataFrame:
    """(first_object_id, object_id) for every object except its cluster's smallest. Re-delivered rows count once.

    Null or invalid channels give no row, clusters of one give none, equal colours share a cluster; an empty table gives no rows; extra columns are ignored.
    """
    p = colour_points(objects)
    return with_labels(p, cluster_labels(p)).filter("id <> first_id").select(F.col("first_id").alias("first_object_id"), F.col("id").alias("object_id")).distinct()


def describe_clusters(objects: DataFrame, top: int = 3) -> DataFrame:
    """One row per cluster: run, first object, number of objects, mean colour, and its ``top`` most typical objects.

    Typical are the medoids: the objects with the least sum of squared distances to all others of their cluster, which are those nearest to the mean colour; ties by number. Sums and ranks are made before the shuffle too, so that no
    cluster is gathered in one task.
    """
    p = colour_points(objects)
    labelled = with_labels(p, cluster_labels(p)).groupBy("grp", "first_id", "id").agg(*(F.first(c).alias(c) for c in "rgb"))
    means = labelled.groupBy("grp", "first_id").agg(F.count("*").alias("size"), *(F.avg(c).alias(f"mean_{c}") for c in "rgb"))
    m = means.select(F.col("grp").alias("g2"), F.col("first_id").alias("f2"), "size", "mean_r", "mean_g", "mean_b")
    far = "+".join(f"(mean_{c} - {c}) * (mean_{c} - {c})" for c in "rgb")
    near = labelled.join(m, [labelled["grp"] == m["g2"], labelled["first_id"] == m["f2"]]).withColumn("d", F.expr(f"round({far}, 6)"))
    # the rank filter is applied before the shuffle too: each task passes on at most ``top`` rows of a cluster
    w = W.partitionBy("grp", "first_id").orderBy("d", "id")
    best = near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return best.groupBy("grp", "first_id").agg(
        F.max("size").alias("size"),
        *(F.round(F.max(f"mean_{c}"), 4).alias(f"mean_{c}") for c in "rgb"),
        F.expr("transform(array_sort(collect_list(struct(rank, id))), x -> x.id)").alias("typical_ids"),
    ).select(F.col("grp").alias("run_id"), F.col("first_id").alias("first_object_id"), "size", "mean_r", "mean_g", "mean_b", "typical_ids")
