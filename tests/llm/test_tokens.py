import os

import pytest

from tessera.llm import tokens as T

pytestmark = pytest.mark.skipif(not os.path.isfile(T.VOCABULARY), reason="no vocabulary")


def test_whole_texts_are_counted(spark):
    enc = T.encoding(open(T.VOCABULARY, "rb").read())
    texts = ["The old sailor sees the small boat.", "", None, "Ночной сторож", "é" * 50_000, "\ud800x".encode("utf-8", "replace").decode(), "  \n\t ", "<|endoftext|>"]
    df = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "k int, text string, tokens int")
    got = {r["k"]: r["tokens"] for r in T.with_tokens(df, "text").collect()}
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert enc.decode(enc.encode_ordinary(texts[3])) == texts[3] and T.with_tokens(df.limit(0), "text").count() == 0


def test_a_missing_vocabulary_is_said(spark):
    with pytest.raises(FileNotFoundError, match="TESSERA_VOCABULARY"):
        T.with_tokens(spark.range(1).selectExpr("'x' AS text"), "text", vocabulary="/nowhere/x.tiktoken")
