"""Joins with status labels, duplicate-key policies, interval overlaps without pairs, closed forms, bounded graph walks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymint.session import cut, drop, skew_join


def outer_with_status(left: DataFrame, right: DataFrame, keys: Sequence[str], left_name: str, right_name: str) -> DataFrame:
    """Full outer join that says for each row how it came out: joined, unjoined_<left> or unjoined_<right>, and why. A key
    with a blank part never matches; its reason names the blank parts."""
    blank = lambda k: F.coalesce(F.trim(F.col(k).cast("string")), F.lit("")) == ""

    def side(df: DataFrame, mark: str) -> DataFrame:
        missing = F.concat_ws("_", *[F.when(blank(k), F.lit(k)) for k in keys])
        df = df.withColumn(f"__{mark}", F.when(missing == "", "ok").otherwise(F.concat(F.lit("missing_"), missing)))
        for i, k in enumerate(keys):
            df = df.withColumn(f"__{mark}{i}", F.when(F.col(f"__{mark}") == "ok", F.col(k))).withColumnRenamed(k, f"__{mark}k{i}")
        return df

    a, b = side(left, "a"), side(right, "b")
    on = [F.col(f"__a{i}") == F.col(f"__b{i}") for i in range(len(keys))]
    j = a.join(b, on, "full_outer")
    status = F.when(F.col("__a").isNull(), f"unjoined_{right_name}").when(F.col("__b").isNull(), f"unjoined_{left_name}").otherwise("joined")
    why = F.when(status == "joined", None).otherwise(F.coalesce(F.nullif(F.coalesce("__a", "__b"), F.lit("ok")), F.lit("no_match")))
    out = j.withColumn("join_status", status).withColumn("unjoined_reason", why)
    for i, k in enumerate(keys):
        out = out.withColumn(k, F.coalesce(f"__ak{i}", f"__bk{i}"))
    return out.drop("__a", "__b", *[f"__{m}{x}{i}" for m in "ab" for x in ("", "k") for i in range(len(keys))])


def one_per_key(df: DataFrame, keys: Sequence[str], order: Column, last: bool = False) -> DataFrame:
    """The first (or last) row of each key by a total order, as an aggregate: a hot key is combined in the map tasks."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    picked = (F.max_by if last else F.min_by)(row, order)
    return df.groupBy(*keys).agg(picked.alias("__row")).select(*keys, "__row.*")


def overlap_counts(df: DataFrame, group: Sequence[str], start: str, end: str) -> DataFrame:
    """For every row how many other rows of its group have an overlapping closed interval, without pairs: all rows less
    those that end before it starts and those that start after it ends. Rows are counted by (group, line) first; running
    sums go over the distinct lines of a group. Rows with a null or reversed interval overlap nothing (0)."""
    ok = df.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
    keys = list(group)
    points = ok.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("x"), F.lit(1).alias("s"), F.lit(0).alias("e")), F.struct(F.col(end).alias("x"), F.lit(0).alias("s"), F.lit(1).alias("e")))).alias("p")).select(*keys, "p.*")
    at = points.groupBy(*keys, "x").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
    w = Window.partitionBy(*keys).orderBy("x")
    run = at.withColumn("ended", F.sum("e").over(w) - F.col("e")).withColumn("begun", F.sum("s").over(w))

    def same(a: str) -> Column:
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"__{a}{k}"))
        return on

    lo = run.select(*[F.col(k).alias(f"__l{k}") for k in keys], F.col("x").alias("__lx"), F.col("ended").alias("__ended"))
    hi = run.select(*[F.col(k).alias(f"__h{k}") for k in keys], F.col("x").alias("__hx"), F.col("begun").alias("__begun"))
    out = df.join(lo, same("l") & (F.col(start) == F.col("__lx")), "left").join(hi, same("h") & (F.col(end) == F.col("__hx")), "left")
    fine = F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end))
    return out.withColumn("overlapping", F.when(fine, F.col("__begun") - F.col("__ended") - 1).otherwise(0).cast("long")).select(*df.columns, "overlapping")


def leave_one_out(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean of ``value`` over the other rows of the key, (sum - x) / (n - 1); null where there are none. Sums are partial
    aggregates, rounded to 9 decimals so that the order of summation does not tip the last of the 6 that come out (half up, in
    double arithmetic); a hot key's rows are spread over several tasks for the join back. Null keys give no rows."""
    df = cut(df, "leave-one-out")
    sums = df.groupBy(*keys).agg(F.round(F.sum(value), 9).alias("__s"), F.count(value).alias("__n"))
    x = F.coalesce(F.col(value), F.lit(0.0))
    others = F.col("__n") - F.col(value).isNotNull().cast("int")
    return skew_join(df, sums, list(keys), F.xxhash64(*df.columns)).withColumn("others_mean", F.floor(F.try_divide(F.col("__s") - x, others) * 1000000.0 + 0.5) / 1000000.0).drop("__s", "__n")


def bounded_walk(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(node, distance): least number of edges (a, b) from any start, up to ``depth``. Each step keeps new nodes only."""
    seen = cut(starts.select("node").distinct().withColumn("distance", F.lit(0)), "walk")
    front = seen
    for d in range(1, depth + 1):
        step = front.join(edges, front["node"] == edges["a"]).select(F.col("b").alias("node")).distinct()
        front = step.join(seen, "node", "left_anti").withColumn("distance", F.lit(d))
        newer = cut(seen.unionByName(front), "walk")
        front = newer.where(F.col("distance") == d)
        drop(seen)
        seen = newer
    return seen
