"""Row rules as columns: which rows break which rule, and readers that refuse what breaks one."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """(``key``, rule) for every rule that a row does not meet; a rule that comes out null is not met. All rules are judged
    in one pass, nothing is shuffled."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def refused(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """``df`` unchanged; the job fails at the first row that breaks a rule, and names the rule."""
    ok = F.lit(True)
    for name, rule in rules.items():
        ok = F.when(F.coalesce(rule, F.lit(False)), ok).otherwise(F.raise_error(F.lit(f"rule broken: {name}")).cast("boolean"))
    return df.where(ok)


def read_model(spark, path: str, schema: str, kind: str, version: int, dim: int) -> DataFrame:
    """The rows of a model kept as JSON documents (format, version, dim, rows); another format, version or dimension, or a
    row whose vector has another length, fails the job."""
    docs = spark.read.schema(f"format string, version int, dim int, rows array<struct<{schema}>>").option("mode", "FAILFAST").json(path)
    docs = refused(docs, {"format": F.col("format") == kind, "version": F.col("version") == version, "dim": F.col("dim") == dim})
    rows = docs.select(F.explode("rows").alias("r")).select("r.*")
    return refused(rows, {"vector": F.size("v") == dim})
