"""Sizes of coded data. The published inputs are not at hand; those that can be made from their description are, with their published ceilings."""

import numpy as np
import pytest

from tessera.operators import codecs as Z

LOREM = (
    "Lorem ipsum dolor sit amet, consetetur sadipscing elitr, sed diam nonumy eirmod tempor invidunt ut labore et dolore magna aliquyam erat, sed diam voluptua. At vero eos et accusam et justo duo "
    "dolores et ea rebum. Stet clita kasd gubergren, no sea takimata sanctus est Lorem ipsum dolor sit amet. "
)
BLACK = b"\0" * 115_200


def text(n=2048):
    return (LOREM * (n // len(LOREM) + 1))[:n].encode()


def picture():
    y, x = np.mgrid[0:160, 0:240]
    r = ((x // 9 + y // 11) % 5 * 6).astype("<u2")
    return (r << 10 | (x * 31 // 239).astype("<u2") << 5 | (y * 31 // 159).astype("<u2")).astype("<u2").tobytes()


@pytest.mark.parametrize("coder,data,most", [
    ("lz4", text, 796), ("lzss", text, 852), ("rans", text, 1592), ("lz4", lambda: BLACK, 1320), ("lzss", lambda: BLACK, 13_616), ("rans", lambda: BLACK, 6),
    ("lz4", picture, 59_528), ("lzss", picture, 63_860), ("rans", picture, 99_044),
])
def test_ceilings(coder, data, most):
    encode, decode = Z.CODERS[coder]
    raw = data()
    out = encode(raw)
    assert len(out) <= most and decode(out) == raw


@pytest.mark.parametrize("coder", list(Z.CODERS))
def test_broken_streams_are_errors(coder):
    encode, decode = Z.CODERS[coder]
    good = encode(text())
    for bad in (b"", good[:4], good[: len(good) // 2], b"\x77" + good[1:]):
        with pytest.raises(Z.CodecError):
            decode(bad)
    for wrong in (b"", b"x" * (1 << 24)):
        with pytest.raises(Z.CodecError):
            Z._head(len(wrong), 0x40)


def test_columns(spark):
    df = spark.createDataFrame([(1, b"abcabcabcabc" * 20), (2, b""), (3, None), (4, b"x")], "k int, payload binary")
    for coder in Z.CODERS:
        rows = {r["k"]: r for r in df.withColumn("e", Z.encode(df["payload"], coder)).withColumn("d", Z.decode(Z.F.col("e"), coder)).collect()}
        assert rows[1]["d"] == rows[1]["payload"] and len(rows[1]["e"]) < 240 * (1.2 if coder != "rans" else 4) and rows[2]["e"] is None and rows[3]["e"] is None and rows[4]["d"] == b"x"
