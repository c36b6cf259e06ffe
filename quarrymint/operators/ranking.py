"""Ordered-group operators: positions, first passes, top-k, labels in rank order, movements, margins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymint.session import cut

#: Stands for a missing rank: after every real one.
LAST = 1 << 62


def order_key(rank: str, tie: str) -> Column:
    """A struct that orders by rank (missing last), then by ``tie``."""
    return F.struct(F.coalesce(F.col(rank), F.lit(LAST)).alias("k"), F.col(tie).alias("t"))


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "position") -> DataFrame:
    """Position from 1 of every row within its group, for groups of any size.

    Rows are range-partitioned by (group, order), so a hot group lies on several tasks; each (group, partition) is numbered
    by itself and moved by the group's counts on the partitions before. The order must be total. Null keys are a group."""
    part, own, n, off, r = (f"__numbered_{x}" for x in ("part", "own", "n", "off", "r"))
    key = {g: f"__numbered_key_{g}" for g in group}
    ranged = cut(df.repartitionByRange(*[F.col(f"`{g}`") for g in group], *order).withColumn(part, F.spark_partition_id()), "numbered")
    counts = ranged.groupBy(*group, part).agg(F.count("*").alias(n))
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(f"`{g}`").alias(k) for g, k in key.items()], F.col(part).alias(own), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(off))
    rows = ranged.withColumn(r, F.row_number().over(Window.partitionBy(*group, part).orderBy(*order)))
    on = F.col(part) == F.col(own)
    for g, k in key.items():
        on = on & F.col(f"`{g}`").eqNullSafe(F.col(f"`{k}`"))
    return rows.join(offsets, on).withColumn(name, (F.col(r) + F.col(off)).cast("long")).drop(part, own, n, off, r, *key.values())


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "position") -> DataFrame:
    """The first k rows of every group; the limit is applied in the map tasks first, so hot groups send k rows a task."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)


def first_label(label: str, order: Column) -> Column:
    """Aggregate: the first non-blank label in rank order."""
    return F.min_by(F.when(~F.col(label).rlike(r"^\s*$"), F.col(label)), F.when(~F.col(label).rlike(r"^\s*$"), order))


def first_where(value: Column, condition: Column, order: Column) -> Column:
    """Aggregate: ``value`` of the first row in rank order that meets the condition, else null."""
    return F.min_by(F.when(condition, value), F.when(condition, order))


def movement(old: Column, new: Column) -> Column:
    """found, lost, unchanged, missing, or the signed number of places gained."""
    return (
        F.when(old.isNull() & new.isNull(), "missing")
        .when(old.isNull(), "found")
        .when(new.isNull(), "lost")
        .when(old == new, "unchanged")
        .otherwise(F.concat(F.when(old > new, "+").otherwise(""), (old - new).cast("string")))
    )


def pass_change(old: Column, new: Column) -> Column:
    """Change of pass at 1: gained, lost, kept or missed."""
    was, now = F.coalesce(old == 1, F.lit(False)), F.coalesce(new == 1, F.lit(False))
    return F.when(was & now, "kept").when(was, "lost").when(now, "gained").otherwise("missed")


def evenly_spaced(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Rows at round-half-even(i * (N - 1) / (n - 1)) of the order, i = 0 .. n - 1 (all rows if N <= n)."""
    rows = numbered(df.withColumn("__one", F.lit(1)), ["__one"], order, "__at").drop("__one")
    size = rows.count()
    if n < 1:
        return rows.where(F.lit(False)).drop("__at")
    wanted = list(range(size)) if size <= n else sorted({round(i * (size - 1) / (n - 1)) for i in range(n)}) if n > 1 else [0]
    picks = df.sparkSession.createDataFrame([(i + 1,) for i in wanted], "__at long")
    return rows.join(F.broadcast(picks), "__at", "left_semi" if n <= 100_000 else "inner").drop("__at")


def evenly_spaced_by(df: DataFrame, group: str, order: Sequence[Column], n: int) -> DataFrame:
    """As :func:`evenly_spaced` in every group: places round-half-even(i * (N - 1) / (n - 1)), n at least 2."""
    rows = numbered(df, [group], order, "__at").join(df.groupBy(F.col(group).alias("__group")).agg(F.count("*").alias("__n")), F.col(group).eqNullSafe(F.col("__group")))
    step, at = (F.col("__n") - 1) / F.lit(float(n - 1)), F.col("__at") - 1
    first = F.round(at / step).cast("long")
    taken = F.exists(F.sequence(first - 1, first + 1), lambda i: (i >= 0) & (i < n) & (F.bround(i * step) == at))
    return rows.where((F.col("__n") <= n) | taken).drop("__at", "__group", "__n")


def round_robin(df: DataFrame, group: str, order: Sequence[Column], per_group: int, cap: int) -> DataFrame:
    """The first ``cap`` rows when the groups take turns, each giving at most ``per_group`` rows in its order."""
    turn = top_k(df, [group], order, per_group, "turn")
    return turn.orderBy("turn", group).limit(cap)
