"""Top N items within every group by descending score bands (problem 2)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymint.session import cut, hot_values

#: Shares of the scored rows from the top at which a band ends; the last band has the rest, and rows without a score come after it.
BANDS = (1 / 16, 1 / 4)


def group_key(columns: Sequence[Column]) -> Column:
    """One text for a group of values, different for different groups; null is a value of its own."""
    parts = [F.coalesce(F.concat(F.length(c.cast("string")), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.concat(*parts)


def _orderable(df: DataFrame, name: str) -> Column:
    """NaN as null, and -0.0 as 0.0."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c + F.lit(0.0))
    return c


def top_n(
    df: DataFrame,
    group: Sequence[Column],
    score: str,
    ties: Sequence[tuple[str, str]],
    key: str,
    n: int,
    bands: Sequence[float] = BANDS,
) -> DataFrame:
    """``key``, ``group_key``, ``rank`` (from 1) of the first ``n`` items of every group.

    Items go by ``score`` descending, then by ``ties`` (column, ``asc`` or ``desc``), then by ``key`` ascending; null and
    NaN count as equal and come last in each. Rows with the same key are one item. Null group values form a group. An
    empty table, or n < 1, gives no rows. Other columns are not read, so their names cannot clash.

    Method: the scored rows are written once, range-partitioned into bands by approximate quantiles of the score (equal
    scores share a band, so the quantiles' error moves work, never results). Bands are taken from the top. In each, the
    groups that are already full are removed by an anti-join before anything is ranked, at every size; the join is by
    shuffle on the group, which the ranking then uses. Hot groups take no part in it (see ``_without``), and their limit is
    applied in the map tasks, so that each sends at most n items per map task. Groups that several bands filled get a last
    exact ranking over at most n items per band. A group travels as 128 bits of its hash.
    """
    names = [score, *(c for c, _ in ties)]
    directions = ["desc", *(d for _, d in ties)]
    whole = group_key(group)
    items = df.select(
        F.xxhash64(whole).alias("g1"),
        F.xxhash64(F.concat(F.lit("#"), whole)).alias("g2"),
        *[_orderable(df, c).alias(f"o{i}") for i, c in enumerate(names)],
        F.col(f"`{key}`").alias("__id"),
    )
    cuts = sorted({v for v in (items.agg(F.percentile_approx("o0", [1 - b for b in bands], 10_000)).first()[0] or [])}, reverse=True)
    band = F.lit(len(cuts))
    for i in reversed(range(len(cuts))):
        band = F.when(F.col("o0") >= F.lit(cuts[i]), i).otherwise(band)
    band = F.when(F.col("o0").isNull(), len(cuts) + 1).otherwise(band)
    banded = cut(items.withColumn("band", band.cast("int")), "topn-bands", ["band"])
    hot = hot_values(banded, F.col("g1"))

    order = [(F.col(f"o{i}").desc_nulls_last() if d == "desc" else F.col(f"o{i}").asc_nulls_last()) for i, d in enumerate(directions)]
    by_group = Window.partitionBy("g1", "g2").orderBy(*order, F.col("__id").asc_nulls_last())
    ranked = lambda rows: rows.withColumn("rank", F.dense_rank().over(by_group)).where(F.col("rank") <= n)

    won: list[DataFrame] = []
    full: DataFrame | None = None
    for b in range(len(cuts) + 2):
        rows = banded.where(F.col("band") == b).drop("band")
        if full is not None:
            rows = _without(rows, full.where(F.col("n") >= n).select("g1", "g2"), hot)
        won.append(cut(ranked(rows).drop("rank").distinct(), f"topn-band{b}"))
        if b <= len(cuts):
            newer = won[-1].groupBy("g1", "g2").agg(F.count("*").alias("n"))
            counted = newer if full is None else full.unionByName(newer).groupBy("g1", "g2").agg(F.sum("n").alias("n"))
            full = cut(counted, "topn-counts")
    name = key if key not in ("group_key", "rank") else f"{key}_"
    return ranked(reduce(DataFrame.unionByName, won)).select(F.col("__id").alias(name), F.concat_ws("-", F.hex("g1"), F.hex("g2")).alias("group_key"), "rank")


def _without(rows: DataFrame, full: DataFrame, hot: Sequence[int]) -> DataFrame:
    """The rows whose group is not among those of ``full``. Of the few hot groups it is known which are full, so their
    rows are dropped or kept in the map task; all others meet ``full`` in an anti-join by shuffle, which the ranking's
    partitioning is."""
    if not hot:
        return rows.join(full.hint("merge"), ["g1", "g2"], "left_anti")
    done = {r["g1"] for r in full.where(F.col("g1").isin(hot)).collect()}  # as few as hot groups
    kept_hot = rows.where(F.col("g1").isin([g for g in hot if g not in done]))
    others = rows.where(~F.col("g1").isin(hot)).join(full.hint("merge"), ["g1", "g2"], "left_anti")
    return kept_hot.unionByName(others)
