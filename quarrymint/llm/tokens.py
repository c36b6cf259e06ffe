"""Token counts and token positions by a public byte-level BPE tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary in use unless a caller names another. Only its path is known here; the file is never copied.
VOCABULARY = os.path.join("/opt/tokenizers", "byte_bpe_50k.tiktoken")
#: The published word pattern that belongs to that vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Rows and bytes of one Arrow batch of texts: bounds what a Python worker holds at once.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(path: str = VOCABULARY, pattern: str = PATTERN) -> np.ndarray:
    """Bytes of each token, by id."""
    e = encoder(path, pattern)
    out = np.zeros(e.n_vocab, dtype=np.int64)
    for i in range(e.n_vocab):
        try:
            out[i] = len(e.decode_single_token_bytes(i))
        except KeyError:
            pass
    return out


def small_batches(df: DataFrame) -> DataFrame:
    """Bound the Arrow batches of this session: texts may be very long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def spread(df: DataFrame, min_partitions: int) -> DataFrame:
    """At least so many partitions: a small file would otherwise be one task of Python work."""
    return df.repartition(min_partitions) if df.rdd.getNumPartitions() < min_partitions else df


def token_counts(df: DataFrame, key: str, text: str, carry: list[str] | None = None, path: str = VOCABULARY) -> DataFrame:
    """``key``, the ``carry`` columns and ``n_tokens`` of every row; a null or empty text has 0."""
    carry = carry or []
    cols = [key, *carry]

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for part in parts:
            out = part[[f"c{i}" for i in range(len(cols))]].copy()
            out["n_tokens"] = np.fromiter((len(e.encode_ordinary(t)) if t else 0 for t in part["t"]), dtype=np.int64, count=len(part))
            yield out

    kinds = ", ".join(f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(cols))
    picked = small_batches(df).select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)], F.col(f"`{text}`").alias("t"))
    out = picked.mapInPandas(count, f"{kinds}, n_tokens long")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)], "n_tokens")
