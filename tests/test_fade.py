import numpy as np
from pyspark.sql import functions as F

from tessera.operators import analytics as M


def _mix(c0, c1, amount):
    out = 0
    for at in (16, 8, 0):
        a = max((c0 >> at & 255) - 8 * amount, 0)
        out = out << 8 | (2 * a + 2 * (c1 >> at & 255) + 1) // 32 * 8
    return out


def _closure(colors, amount):
    queue, counts = list(colors), {}
    while queue:
        c0 = queue.pop(0)
        counts.setdefault(c0, 1)
        for c1 in sorted(counts):
            c = _mix(c0, c1, amount)
            if c in colors:
                continue
            if c in counts:
                counts[c] += 1
            elif c not in queue:
                queue.append(c)
    return counts


def test_closure_and_counts():
    for colors, amount in (([0x102030, 0xF0E0D0], 1), ([0xFF0000, 0x00FF00], 8), ([0x123456], 1), ([0xFFFFFF, 0xFFFFFF, 8], 2)):
        have, n = M.fade_closure(colors, amount)
        assert dict(zip(have.tolist(), n.tolist())) == _closure(colors, amount)
    assert M.fade_mix(np.int64(0xFF0008), np.int64(0xFF0008), 1, swap=True) == 0x0000F8


def test_whole_index_map(spark):
    given = [0x102030, 0xF0E0D0, 0x00FF00]
    pal = M.fade_palette(given, 1)
    assert pal[:3] == given and 3 < len(pal) <= 256
    df = spark.createDataFrame(list(enumerate(given)), "idx int, xrgb int")
    rows = {r["pair"]: r for r in M.fade_index_map(df, 1).collect()}
    assert sorted(rows) == list(range(65536))
    assert all(r["xrgb"] == pal[r["idx"]] for r in rows.values())
    for i in range(0, len(pal), 7):
        for j in range(0, len(pal), 11):
            if (m := _mix(pal[i], pal[j], 1)) in pal:
                assert rows[i << 8 | j]["idx"] == pal.index(m)
    assert all(r["idx"] == 0 for p, r in rows.items() if p >> 8 >= len(pal) or p & 255 >= len(pal))
