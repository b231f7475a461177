"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY_FILE = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the public pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(vocabulary_file: str = VOCABULARY_FILE):
    """The tokenizer; each Python worker loads it once."""
    import tiktoken

    with open(vocabulary_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str = "text", vocabulary_file: str = VOCABULARY_FILE, name: str = "n_tokens") -> DataFrame:
    """df with the number of tokens of the whole text; 0 where it is null."""

    @F.pandas_udf("bigint")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(vocabulary_file)
        for p in parts:
            yield pd.Series([len(e.encode_ordinary(t)) if t else 0 for t in p], dtype="int64")

    return df.withColumn(name, count(F.col(text)))
