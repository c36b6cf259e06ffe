"""Mixing sources to target weights by hash thresholds, without a sort (problem 8)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymint.session import cut

#: Bits of the hash in use, and most rows of one level's histogram, all sources together: the driver sees no more.
HASH_BITS, MOST_CELLS = 60, 1 << 20
#: Most rows that the table of targets may have: it is collected, and its size bounds the histograms that are.
MOST_SOURCES = 100_000


@dataclass
class Budget:
    source: str
    share: float
    max_repeats: int
    available: int = 0
    docs: int = 0
    budget: float = 0.0
    full: int = 0
    threshold: int = 0  # rows whose hash is below it come once more


def source_name(c: Column) -> Column:
    """One spelling: lower case, runs of other characters as one underscore, none at the ends; blank is null."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit(""))


def level_bits(sources: int) -> int:
    """Bits that one level of the histogram splits by: as many of 12 as so many sources leave room for."""
    return next(b for b in (12, 10, 6, 5, 4, 3, 2, 1) if sources << b <= MOST_CELLS or b == 1)


def plan_mix(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> list[Budget]:
    """Repeats and hash thresholds for each source of ``targets`` (source, target_share, max_repeats), from ``sized``
    (source, h in [0, 2^60), n_tokens).

    Tokens are summed by source and hash bucket. The bucket in which the budget ends is the only one that is refined, by
    the next bits, level by level. Thresholds nest: a larger budget keeps all that a smaller one had."""
    rows = targets.limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError("too many sources")
    budgets = {r["source"]: Budget(r["source"], r["target_share"] or 0.0, max(0, r["max_repeats"] or 0)) for r in rows}
    bits = level_bits(len(budgets))
    levels_ = HASH_BITS // bits
    shift = bits * (levels_ - 1)
    first = sized.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("n_tokens").alias("t"), F.count("*").alias("c")).collect()
    levels: dict[str, dict[int, int]] = {s: {} for s in budgets}
    for r in first:
        b = budgets[r["source"]]
        b.available += r["t"]
        b.docs += r["c"]
        levels[r["source"]][r["b"]] = r["t"]
    total = sum(b.available for b in budgets.values() if b.share > 0) if total_tokens is None else total_tokens
    open_: dict[str, float] = {}
    for s, b in budgets.items():
        b.budget = b.share * total
        if b.available:
            b.full = int(min(b.max_repeats, b.budget // b.available))
            if b.full < b.max_repeats and b.budget > b.full * b.available:
                open_[s] = b.budget - b.full * b.available
    edge = {s: 0 for s in open_}
    for level in range(levels_):
        shift = bits * (levels_ - 1 - level)
        for s in list(open_):
            here = levels.get(s, {})
            for bucket in range(edge[s], edge[s] + (1 << bits)):
                t = here.get(bucket, 0)
                if t > open_[s]:
                    if level == levels_ - 1 and open_[s] * 2 >= t:  # rows of one hash: nearer with them than without
                        bucket += 1
                    break
                open_[s] -= t
            else:
                bucket += 1
                del open_[s]
            edge[s] = bucket
            budgets[s].threshold = edge[s] << shift
        if not open_ or level == levels_ - 1:
            break
        spark = sized.sparkSession
        bounds = spark.createDataFrame([(s, edge[s]) for s in open_], "source string, __edge long")
        finer = (
            sized.join(F.broadcast(bounds), "source")
            .where(F.shiftright("h", shift) == F.col("__edge"))
            .groupBy("source", F.shiftright("h", shift - bits).alias("b"))
            .agg(F.sum("n_tokens").alias("t"))
            .collect()
        )
        levels = {s: {} for s in open_}
        for r in finer:
            levels[r["source"]][r["b"]] = r["t"]
        edge = {s: edge[s] << bits for s in open_}
    return list(budgets.values())


def with_hash(df: DataFrame, key: str, source: str, size: str) -> DataFrame:
    """``key``, normalized source, size, and a 60-bit hash of the key."""
    h = F.shiftrightunsigned(F.xxhash64(F.col(f"`{key}`")), 64 - HASH_BITS)
    return df.select(F.col(f"`{key}`").alias("k"), source_name(F.col(f"`{source}`")).alias("source"), F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("long").alias("n_tokens"), h.alias("h"))


def mix(df: DataFrame, key: str, source: str, size: str, targets: DataFrame, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture (``key``, source, n_tokens, copy_no from 1) and a report of the shares reached.

    Each source of ``targets`` gets ``target_share`` of ``total_tokens`` (by default all tokens of the listed sources).
    A source with too few tokens has all its records repeated, the last time in part, but no record comes more than
    ``max_repeats`` times; what it lacks is in the report, beside its share of the total asked for (share_of_total) and of
    the mixture as it came out (actual_share, higher for the others where a source lacks tokens). Sources are compared in one spelling; targets that are one source in it are one target, with the sum of
    their shares and the greatest number of repeats; records of a source that
    is not listed, null or blank are in no target and stay out, and the report counts them under a null source. Records
    without tokens belong to the mixture where their hash does. Which records are kept depends on their key's hash alone.
    """
    spark = df.sparkSession
    goals = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("long").alias("max_repeats"))
    goals = goals.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    sized = cut(with_hash(df, key, source, size), "mixing-sized")
    listed = [r[0] for r in goals.select("source").limit(MOST_SOURCES).collect()]
    names = spark.createDataFrame([(s,) for s in listed], "source string")
    wanted = sized.join(F.broadcast(names), "source", "left_semi")
    plan = plan_mix(wanted, goals, total_tokens)
    table = spark.createDataFrame(
        [(b.source, b.share, b.max_repeats, b.available, b.docs, b.budget, b.full, b.threshold) for b in plan],
        "source string, target_share double, max_repeats long, available_tokens long, available_docs long, budget double, full long, threshold long",
    )
    repeats = F.col("full") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)
    chosen = wanted.join(F.broadcast(table.select("source", "full", "threshold")), "source").withColumn("r", repeats.cast("int")).where(F.col("r") > 0)
    reached = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("r")).alias("mixed_tokens"), F.max("r").cast("long").alias("most_repeats"))
    total = reached.agg(F.sum("mixed_tokens").alias("all_tokens"))
    unlisted = sized.join(F.broadcast(names), "source", "left_anti").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("available_tokens"), F.count("*").alias("available_docs"))
    report = (
        table.drop("full", "threshold")
        .join(reached, "source", "left")
        .unionByName(unlisted.withColumn("source", F.lit(None).cast("string")), allowMissingColumns=True)
        .join(F.broadcast(total), F.lit(True), "left")
        .select(
            "source",
            "target_share",
            "max_repeats",
            "available_tokens",
            "available_docs",
            F.round("budget", 3).alias("budget"),
            F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
            F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
            F.round(F.try_divide(F.coalesce("mixed_tokens", F.lit(0)).cast("double"), F.col("all_tokens")), 6).alias("actual_share"),
            F.round(F.try_divide(F.coalesce("mixed_tokens", F.lit(0)) * F.col("target_share"), F.col("budget")), 6).alias("share_of_total"),
            F.round(F.greatest(F.lit(0.0), F.col("budget") - F.coalesce("mixed_tokens", F.lit(0))), 3).alias("lacking_tokens"),
        )
    )
    name = key if key not in ("source", "n_tokens", "copy_no") else f"{key}_"
    rows = chosen.select(F.col("k").alias(name), "source", "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), F.col("r").cast("long"))).alias("copy_no"))
    return rows, report
