"""Rows that fail to parse: minimum-cost error parse of delimited records.

Every record is parsed by a dynamic program over (parser state, fields so far). Its moves read a character
at no cost, or edit the record: insert a quote, delete a quote, insert a delimiter, delete a delimiter. Edits
that mend broken quoting weigh more than any number of edits that only change the count of fields, so that
the cheapest parse has a quote edit only if the quoting rules are broken. A record whose cheapest parse costs nothing and
whose fields have valid types loads; for the others the edits of the cheapest parse, or the first invalid field, give the reason.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parser states: at the start of a field, in a plain field, in a quoted field, behind a closing quote.
_START, _PLAIN, _QUOTED, _CLOSED = range(4)
#: A quoting edit costs as much as this many field-count edits.
_QUOTING = 1 << 20

PARSED = T.StructType(
    [
        T.StructField("fields", T.ArrayType(T.StringType())),
        T.StructField("quote_edits", T.IntegerType()),
        T.StructField("delimiter_edits", T.IntegerType()),
        T.StructField("edits", T.StringType()),
    ]
)


def _free_pattern(columns: int, delimiter: str) -> re.Pattern:
    d = re.escape(delimiter)
    field = rf'(?:"([^"]*(?:""[^"]*)*)"|([^{d}"]*))'
    return re.compile(rf"\A{d.join([field] * columns)}\Z", re.S)


def _free_parse(pattern: re.Pattern, record: str) -> list[str] | None:
    """The path of the program that never leaves cost zero; None if there is none."""
    m = pattern.match(record)
    if m is None:
        return None
    g = m.groups()
    return [g[i].replace('""', '"') if g[i] is not None else g[i + 1] for i in range(0, len(g), 2)]


def min_cost_parse(record: str, columns: int = 4, delimiter: str = ",") -> tuple[list[str], int, int, str]:
    """Cheapest parse of a record into ``columns`` fields.

    Returns the fields, the number of edits that mend quoting, the number that mend the field count, and the
    edits as text, such as ``insert quote at 12``. Cells of the program are (position, state, fields so far); positions
    are those between quotes, delimiters and the stretches of other characters, within which no edit can be of use.
    """
    tokens = re.findall(rf'["{re.escape(delimiter)}]|[^"{re.escape(delimiter)}]+', record)
    places = [0]
    for t in tokens:
        places.append(places[-1] + len(t))
    n = len(tokens)
    full = columns - 1
    width = 4 * columns
    start = 0 * columns  # state _START, no field ended
    inf = float("inf")
    cost: list[float] = [inf] * width
    cost[start] = 0
    back: list[dict[int, tuple]] = []

    def at(state: int, k: int) -> int:
        return state * columns + k

    def inserts(cost: list[float], i: int, ptr: dict[int, tuple]) -> None:
        """Moves that read nothing: they lead from one cell of a position to another one of it."""
        nxt = tokens[i] if i < n else None
        where = places[i]
        for _ in range(2):
            for k in range(columns):
                for state in (_START, _PLAIN, _QUOTED, _CLOSED):
                    c = cost[at(state, k)]
                    if c == inf:
                        continue
                    # insert a delimiter: behind a closing quote, or before a quote in a plain field, it mends quoting
                    if state != _QUOTED and k < full:
                        mends = state == _CLOSED and nxt not in (delimiter, None) or state == _PLAIN and nxt == '"'
                        t, w = at(_START, k + 1), c + (_QUOTING if mends else 1)
                        if w < cost[t]:
                            cost[t] = w
                            ptr[t] = (at(state, k), "insert delimiter", where, mends)
                    # insert a quote: it opens a field or closes one
                    if state in (_START, _QUOTED):
                        t, w = at(_QUOTED if state == _START else _CLOSED, k), c + _QUOTING
                        if w < cost[t]:
                            cost[t] = w
                            ptr[t] = (at(state, k), "insert quote", where, True)

    ptr0: dict[int, tuple] = {}
    inserts(cost, 0, ptr0)
    inner = [ptr0]
    for i, ch in enumerate(tokens):
        where = places[i]
        new: list[float] = [inf] * width
        ptr: dict[int, tuple] = {}

        def go(t: int, w: float, came: tuple) -> None:
            if w < new[t]:
                new[t] = w
                ptr[t] = came

        for k in range(columns):
            for state in (_START, _PLAIN, _QUOTED, _CLOSED):
                c = cost[at(state, k)]
                if c == inf:
                    continue
                here = at(state, k)
                if ch == '"':
                    if state == _START:
                        go(at(_QUOTED, k), c, (here, None, where, False))
                    elif state == _QUOTED:
                        go(at(_CLOSED, k), c, (here, None, where, False))
                    elif state == _CLOSED:  # a doubled quote
                        go(at(_QUOTED, k), c, (here, "doubled", where, False))
                    go(here, c + _QUOTING, (here, "delete quote", where, True))
                elif ch == delimiter:
                    if state == _QUOTED:
                        go(here, c, (here, None, where, False))
                    else:
                        if k < full:
                            go(at(_START, k + 1), c, (here, None, where, False))
                        # the fields on both sides become one; its second part is read like a field's start
                        go(at(_START, k), c + 1, (here, "delete delimiter", where, False))
                else:
                    if state in (_START, _PLAIN):
                        go(at(_PLAIN, k), c, (here, None, where, False))
                    elif state == _QUOTED:
                        go(here, c, (here, None, where, False))
        more: dict[int, tuple] = {}
        inserts(new, i + 1, more)
        back.append(ptr)
        inner.append(more)
        cost = new

    ends = [at(s, full) for s in (_START, _PLAIN, _CLOSED)]
    cell = min(ends, key=lambda e: cost[e])
    edits: list[str] = []
    quotes = delimiters = 0
    pieces: list[list[str]] = [[] for _ in range(columns)]
    i = n
    while True:
        while cell in inner[i]:
            prev, what, where, mends = inner[i][cell]
            edits.append(f"{what} at {where}")
            quotes, delimiters = quotes + bool(mends), delimiters + (not mends)
            cell = prev
        if i == 0:
            break
        i -= 1
        prev, what, where, mends = back[i][cell]
        if what in ("delete quote", "delete delimiter"):
            edits.append(f"{what} at {where}")
            quotes, delimiters = quotes + bool(mends), delimiters + (not mends)
        else:
            state, k = divmod(cell, columns)
            ch = tokens[i]
            if what == "doubled" or ch not in ('"', delimiter) or ch == delimiter and state == _QUOTED:
                pieces[k].append(ch)
        cell = prev
    return ["".join(reversed(p)) for p in pieces], quotes, delimiters, "; ".join(reversed(edits))


def _parse_udf(columns: int, delimiter: str):
    @F.pandas_udf(PARSED)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pattern = _free_pattern(columns, delimiter)
        for records in batches:
            rows = []
            for r in records:
                if r is None:
                    rows.append((None, 0, columns, "no record"))
                    continue
                fields = _free_parse(pattern, r)
                rows.append((fields, 0, 0, "") if fields is not None else min_cost_parse(r, columns, delimiter))
            yield pd.DataFrame(rows, columns=PARSED.names)

    return parse


def parse_records(df: DataFrame, record_col: str, columns: int = 4, delimiter: str = ",", out: str = "parsed") -> DataFrame:
    """Add struct ``out`` with the cheapest parse of every record; one line end at the record's end is no part of it.

    A null record has no fields and counts as a wrong field count; an empty record is one empty field. Rows are kept as they are,
    repeated ones too; other columns pass through, and one that is already named ``out`` is replaced.
    """
    record = F.regexp_replace(F.col(f"`{record_col}`"), r"(\r\n|\n|\r)\z", "")
    return df.withColumn(out, _parse_udf(columns, delimiter)(record))


def _time_ms(c: Column) -> Column:
    p = lambda a, n: F.substring(c, a, n).cast("long")
    return ((p(1, 2) * 60 + p(4, 2)) * 60 + p(7, 2)) * 1000 + p(10, 3)


def load_subtitle_frames(df: DataFrame, record_col: str = "raw_record", id_col: str = "raw_id") -> DataFrame:
    """Parse subtitle records ``index,start,end,text`` and say why a record does not load.

    Output: ``id_col``, ``reason`` (null if the record loads), ``edits``, ``sub_idx``, ``start_s``, ``end_s``, ``text``.
    The reason is the first that applies of quoting, columns, index, start, end, order, text. The typed columns are
    null for records that do not load. Nulls and empty records get reason ``columns``; ties and repeated rows stay separate rows.
    """
    p = parse_records(df.select(F.col(id_col), F.col(record_col).alias("_rec")), "_rec", 4, ",", "_p")
    f = lambda i: F.col("_p.fields")[i]
    time_ok = lambda c: c.rlike(r"\A[0-9]{2}:[0-5][0-9]:[0-5][0-9],[0-9]{3}\z")
    start, end = F.when(time_ok(f(1)), _time_ms(f(1))), F.when(time_ok(f(2)), _time_ms(f(2)))
    reason = (
        F.when(F.col("_p.quote_edits") > 0, "quoting")
        .when(F.col("_p.delimiter_edits") > 0, "columns")
        .when(~f(0).rlike(r"\A[0-9]+\z") | f(0).rlike(r"\A0+\z"), "index")
        .when(start.isNull(), "start")
        .when(end.isNull(), "end")
        .when(end <= start, "order")
        .when(f(3).rlike(r"\A[ \t\r\n]*\z") | f(3).rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), "text")
    )
    ok = F.col("reason").isNull()
    return p.withColumn("reason", reason).select(
        id_col,
        "reason",
        F.col("_p.edits").alias("edits"),
        F.when(ok, F.expr("try_cast(_p.fields[0] AS bigint)")).alias("sub_idx"),
        F.when(ok, start / 1000.0).alias("start_s"),
        F.when(ok, end / 1000.0).alias("end_s"),
        F.when(ok, f(3)).alias("text"),
    )
