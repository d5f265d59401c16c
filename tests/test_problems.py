import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import badrows as B
from tessera.operators import intervals as I


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='ab",\n ', max_size=6), min_size=4, max_size=4))
def test_written_records_parse_at_no_cost(fields):
    record = ",".join('"' + f.replace('"', '""') + '"' if any(c in f for c in '",\n') else f for f in fields)
    got = B._free_parse(B._free_pattern(4, ","), record)
    assert got == fields and B.min_cost_parse(record)[:3] == (fields, 0, 0)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='ab",', max_size=14))
def test_cheapest_edits_lead_to_a_record(record):
    fields, quotes, delimiters, edits = B.min_cost_parse(record)
    assert len(fields) == 4 and (quotes + delimiters == 0) == (B._free_parse(B._free_pattern(4, ","), record) is not None)
    if "delete delimiter" in edits:  # joins two fields, each of which may be quoted: the result is no record but a list of fields
        return
    out, shift = record, 0
    for e in filter(None, edits.split("; ")):  # the edits, done to the record, make it parse
        what, where = e.rsplit(" at ", 1)
        at = int(where) + shift
        sign = '"' if what.endswith("quote") else ","
        if what.startswith("insert"):
            out, shift = out[:at] + sign + out[at:], shift + 1
        else:
            assert out[at] == sign
            out, shift = out[:at] + out[at + 1 :], shift - 1
    assert B._free_parse(B._free_pattern(4, ","), out) == fields


def test_reasons(spark):
    bad = {
        '1,"00:00:01,000",x': "columns", '1,"00:00:01,000","00:00:02,000",x"': "quoting", '0,"00:00:01,000","00:00:02,000",x': "index", '1,"00:00:61,000","00:00:02,000",x': "start",
        '1,"00:00:01,000","00:00:02.000",x': "end", '1,"00:00:02,000","00:00:02,000",x': "order", '1,"00:00:01,000","00:00:02,000", ': "text", "": "columns", None: "columns",
        '1,"00:00:01,000","00:00:02,000","a\nb"\r\n': None, '1,"00:00:01,000","00:00:02,000",' + "long " * 50_000: None,
    }
    df = spark.createDataFrame(list(enumerate(bad)), "raw_id long, raw_record string").withColumnRenamed("x", "x")
    got = {r["raw_id"]: r for r in B.load_subtitle_frames(df.unionByName(df)).collect()}
    assert [got[i]["reason"] for i in range(len(bad))] == list(bad.values())
    assert got[9]["text"] == "a\nb" and got[9]["start_s"] == 1.0 and B.load_subtitle_frames(df.limit(0)).count() == 0


def _brute(frames):
    out = {}
    for k, a, b in frames:
        if a is None or b is None or a != a or b != b or not b > a:
            continue
        a, b = round(a * 1000), round(b * 1000)
        if b > a:
            out.setdefault(k, []).append((a, b))
    gaps, periods = [], []
    for k, iv in out.items():
        iv.sort()
        merged = [list(iv[0])]
        for a, b in iv[1:]:
            if a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        periods += [(k, a, b) for a, b in merged]
        gaps += [(k, x[1], y[0]) for x, y in zip(merged, merged[1:])]
    key = lambda r: (r[0] is None, r)
    return sorted(gaps, key=key), sorted(periods, key=key)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_gaps_and_periods(spark, kind):
    r = random.Random(1)
    frames = [(r.choice([1, 1, 1, 2, 3]), r.randrange(-200, 4000) / 4, 0.0) for _ in range(600)]
    frames = [(k, a, a + r.choice([-1, 0, 0.25, 1, 1, 3, 900])) for k, a, _ in frames if r.random() < 0.99]
    frames += [(1, None, 2.0), (2, float("nan"), 3.0), (2, 3.0, float("nan")), (4, 1.0, 1.0)] + frames[:20]
    if kind == "string":
        frames = [(f"k{k}", a, b) for k, a, b in frames]
    else:
        frames += [(None, 1.0, 2.0), (None, 5.0, 6.0)]
    df = spark.createDataFrame([(k, a, b, "x", 0) for k, a, b in frames], f"k {kind}, a double, b double, key string, slot int").repartition(5)
    key = lambda x: (x[0] is None, x)
    for slot in (1000, 600_000):
        got = tuple(sorted((tuple(x) for x in f(df, "k", "a", "b", slot).collect()), key=key) for f in (I.gaps, I.periods))
        assert got == _brute(frames)
    assert I.gaps(df.limit(0), "k", "a", "b").count() == 0 and I.periods(df.limit(0), "k", "a", "b").count() == 0
