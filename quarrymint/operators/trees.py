"""Recursive walks over nested records of unknown shape, kept as JSON text: one row for each node at any depth."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymint.operators.nested import strict_json

_KINDS = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}


def _scalar(value) -> str | None:
    if isinstance(value, bool):
        return "true" if value else "false"
    return "null" if value is None else str(value)


def json_nodes(df: DataFrame, key: str, column: str, root: str = "root") -> DataFrame:
    """``key``, path, name, kind, in_array, size and text of every node of the JSON text in ``column``.

    ``path`` starts with ``root``; a member adds ``.name``, an element ``[]``. ``name`` is a member's own name, null for the
    root and for elements. ``size`` is the length of an array, ``text`` the value of a scalar (null, true, false, numbers as
    Python writes them). Null, blank and invalid lines give no rows. The walk keeps its own stack, so depth is bounded by
    the JSON reader alone; a record's nodes never meet another's, so nothing is shuffled.
    """
    columns = ["key", "path", "name", "kind", "in_array", "size", "text"]

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for k, line in zip(part["key"], part["line"], strict=True):
                try:
                    todo = [(root, None, strict_json(line), False)] if line else []
                except ValueError:
                    continue
                while todo:
                    path, name, value, in_array = todo.pop()
                    kind = _KINDS[type(value)]
                    nested = kind in ("object", "array")
                    rows.append((k, path, name, kind, in_array, len(value) if kind == "array" else None, None if nested else _scalar(value)))
                    if kind == "object":
                        todo.extend((f"{path}.{n}", n, v, False) for n, v in value.items())
                    elif kind == "array":
                        todo.extend((f"{path}[]", None, v, True) for v in value)
                if len(rows) >= 20_000:
                    yield pd.DataFrame(rows, columns=columns).astype({"size": "Int64"})
                    rows = []
            yield pd.DataFrame(rows, columns=columns).astype({"size": "Int64"})

    kind = df.schema[key].dataType.simpleString()
    picked = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{column}`").alias("line"))
    out = picked.mapInPandas(walk, f"key {kind}, path string, name string, kind string, in_array boolean, size long, text string")
    return out.withColumnRenamed("key", key if key not in columns[1:] else f"{key}_")


def flat_features(nodes: DataFrame, key: str) -> DataFrame:
    """(``key``, feature): ``path:present`` for members, ``path:len=n`` for arrays, ``path:item=v`` for scalars in arrays and
    ``path=v`` for other scalars."""
    holder = F.regexp_replace("path", r"\[\]$", "")
    value = F.when(F.col("in_array"), F.concat(holder, F.lit(":item="), "text")).otherwise(F.concat("path", F.lit("="), "text"))
    parts = F.array(
        F.when(F.col("name").isNotNull(), F.concat("path", F.lit(":present"))),
        F.when(F.col("kind") == "array", F.concat("path", F.lit(":len="), F.col("size").cast("string"))),
        F.when(F.col("text").isNotNull(), value),
    )
    return nodes.select(key, F.explode(F.array_compact(parts)).alias("feature"))


def keys_found(nodes: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """(``key``, name, n): members of the given names at any depth."""
    return nodes.where(F.col("name").isin(list(names))).groupBy(key, "name").agg(F.count("*").alias("n"))


def numbers_of(nodes: DataFrame, wanted: Column) -> DataFrame:
    """The numeric members that meet ``wanted`` (a condition on name and path), with ``number``; booleans are none."""
    return nodes.where((F.col("kind") == "number") & F.col("name").isNotNull() & wanted).withColumn("number", F.col("text").cast("double"))
