"""Splits of keys by a stable fraction or by order, with the repairs that keep either side from being empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymint.functions.hashing import stable_fraction


def _repaired(marked: DataFrame) -> DataFrame:
    """``marked`` (key, validation): without a validation key the least key becomes one; without a training key the
    greatest becomes one, or, where there is one key alone, that key is on both sides and nothing is held out. What is
    decided comes from one aggregate row."""
    whole = marked.agg(F.count("*").alias("n"), F.count_if("validation").alias("v"), F.min("key").alias("least"), F.max("key").alias("most"))
    none, all_ = F.col("v") == 0, (F.col("v") == F.col("n")) | ((F.col("n") == 1) & (F.col("v") == 0))
    one = F.col("n") == 1
    validation = F.when(none, F.col("key") == F.col("least")).when(all_ & ~one, F.col("validation") & (F.col("key") != F.col("most"))).otherwise(F.col("validation"))
    joined = marked.join(F.broadcast(whole), F.lit(True))  # one row
    return joined.select("key", validation.alias("validation"), (~validation | one).alias("train"), (~one).alias("held_out"))


def group_split(keys: DataFrame, salt: str, fraction: float) -> DataFrame:
    """(key, validation, train, held_out) of the distinct texts in ``keys`` (key): validation below ``fraction`` of the
    stable fraction of ``salt:key``. Null keys are left out; an empty table gives no rows."""
    k = keys.where(F.col("key").isNotNull()).select("key").distinct()
    return _repaired(k.select("key", (stable_fraction(F.concat(F.lit(f"{salt}:"), "key")) < fraction).alias("validation")))
