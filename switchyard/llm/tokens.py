"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default vocabulary, a rank file of byte-level BPE.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: Column, path: str | None = None) -> Column:
    """Number of tokens of a text; null for a null text. The vocabulary is loaded once per worker."""
    path = path or vocabulary_path()

    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        encode = _encoding(path).encode_ordinary
        return pd.Series([None if t is None else len(encode(t)) for t in texts], dtype="Int64")

    return of(text)


def sized(docs: DataFrame, doc_id: str, text: str, path: str | None = None, *keep: str) -> DataFrame:
    """doc_id, the kept columns and n_tokens of documents with at least one token."""
    return docs.select(doc_id, *keep, count_tokens(F.col(text), path).alias("n_tokens")).where("n_tokens > 0")
