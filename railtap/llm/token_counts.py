"""Token counts by the whole-token shortcut.

Before the job, :func:`railtap.llm.byte_bpe.whole_tokens` proves which strings of
the vocabulary encode alone as one token; pre-tokens among them are counted
without being merged, and only the rest go through the library.  The set goes
to the tasks with the function; its size is that of the vocabulary.

A file of another kind (a sentencepiece model, a vocabulary with a normalizer)
has no such proof: its library counts every text in full.

Edge cases: a null or empty text has 0 bytes and 0 tokens.  Texts of any
length are counted whole.  Special strings inside a text count as the library
takes them by default.  Rows are independent, so repeated rows, null ids and
empty tables pass through.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railtap.llm import byte_bpe


@lru_cache(maxsize=1)
def _counter(path: str, whole: frozenset[str]):
    return byte_bpe.Counts(path, whole).of


@lru_cache(maxsize=1)
def _library(path: str):
    if path.endswith(".model"):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text)) if text else 0
    full = byte_bpe.tokenizer(path)
    return lambda text: len(full.encode(text, add_special_tokens=False).ids) if text else 0


def n_tokens(text: Column, path: str) -> Column:
    """The number of tokens of ``text`` under the vocabulary file at ``path`` (the same place on every machine)."""
    whole = byte_bpe.whole_tokens(path) if byte_bpe.is_byte_level(path) else None

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        of = _library(path) if whole is None else _counter(path, whole)
        return pd.Series([of(t) for t in texts], dtype="int64")

    return count(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether the document has more than ``limit`` tokens."""
    df = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                     n_tokens(F.col("text"), path).alias("n_tokens"))
    return df.withColumn("over_limit", F.col("n_tokens") > limit)
