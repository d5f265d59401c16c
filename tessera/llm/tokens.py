"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vocabulary file of a public tokenizer (ranks of byte-level BPE, one token and its rank a line), read on the driver and broadcast: less than 1 MB.
VOCABULARY = os.environ.get("TESSERA_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the published splitting pattern that belongs to these vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoding(raw: bytes, pattern: str = PATTERN):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str, out: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """Add the number of tokens of the whole text; a null or empty text has none. An existing column ``out`` is replaced."""
    if not os.path.isfile(vocabulary):
        raise FileNotFoundError(f"no vocabulary file {vocabulary}: give its path as ``vocabulary``, or in TESSERA_VOCABULARY")
    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(shared.value)
        for s in batches:
            yield pd.Series([len(enc.encode_ordinary(t.encode("utf-8", "replace").decode("utf-8"))) if t else 0 for t in s], dtype="int64")

    return df.withColumn(out, count(F.col(text)))
