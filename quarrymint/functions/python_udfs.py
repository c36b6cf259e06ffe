"""The few functions that built-in columns cannot express, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import ast
import difflib
import hashlib
import warnings
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gestalt_ratio(left, right):
    """Ratio of matching blocks of two texts (0 to 1); null where one is null."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype=float)

    return ratio(left, right)


def blake2b_cell(feature, dim: int):
    """Struct (bucket, sign) of a feature by its BLAKE2b-64 digest, for indexes that were built with that hash: bucket by the
    first four bytes, sign by the fifth."""

    @F.pandas_udf("bucket int, sign double")
    def cell(f: pd.Series) -> pd.DataFrame:
        digests = [None if x is None else hashlib.blake2b(x.encode(), digest_size=8).digest() for x in f]
        bucket = pd.array([None if d is None else int.from_bytes(d[:4], "big") % dim for d in digests], dtype="Int32")
        return pd.DataFrame({"bucket": bucket, "sign": [None if d is None else 1.0 - 2.0 * (d[4] % 2) for d in digests]})

    return cell(feature)


def blake2b_tenth(text):
    """0 to 9 by the two-byte BLAKE2b digest of a text."""

    @F.pandas_udf("int")
    def tenth(f: pd.Series) -> pd.Series:
        return f.map(lambda x: None if x is None else int.from_bytes(hashlib.blake2b(x.encode(), digest_size=2).digest(), "big") % 10).astype("Int32")

    return tenth(text)


def ast_features(df: DataFrame, key: str, source: str) -> DataFrame:
    """(key, feature, n): how often each kind of syntax node occurs in a Python source; a source that does not parse has one
    row whose feature is null, a null source none."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for k, text in zip(part["k"], part["t"], strict=True):
                try:
                    with warnings.catch_warnings():
                        warnings.simplefilter("ignore")
                        tree = ast.parse(text)
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    rows.append((k, None, 0))
                    continue
                rows.extend((k, f, n) for f, n in Counter(type(x).__name__ for x in ast.walk(tree)).items())
            yield pd.DataFrame(rows, columns=["k", "feature", "n"])

    kind = df.schema[key].dataType.simpleString()
    texts = df.select(F.col(key).alias("k"), F.col(source).alias("t")).where(F.col("t").isNotNull())
    return texts.mapInPandas(count, f"k {kind}, feature string, n long").withColumnRenamed("k", key)
