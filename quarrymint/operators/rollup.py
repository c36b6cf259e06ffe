"""Aggregations: rollups over several dimensions at once, rank metrics, calibration, confusion, histograms, centroids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def by_dimensions(df: DataFrame, dimensions: Mapping[str, Column | None], *aggregates: Column) -> DataFrame:
    """One grouping set for each dimension, and for a None the total: rows are unpivoted once, then grouped once by
    (dimension, value). A null value is written ``(none)``, the total ``*``."""
    parts = [F.struct(F.lit(n).alias("d"), (F.lit("*") if c is None else F.coalesce(c.cast("string"), F.lit("(none)"))).alias("v")) for n, c in dimensions.items()]
    wide = df.withColumn("__x", F.explode(F.array(*parts)))
    return wide.groupBy(F.col("__x.d").alias("dimension"), F.col("__x.v").alias("value")).agg(*aggregates)


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """Rounded a / b, null where b is 0."""
    return F.round(F.try_divide(a.cast("double"), b), digits)


def ratio0(a: Column, b: Column, digits: int = 6) -> Column:
    """Rounded a / b, 0 where b is 0."""
    return F.coalesce(ratio(a, b, digits), F.lit(0.0))


def rank_metrics(first: Column, size: Column, k: int = 3) -> list[Column]:
    """Aggregates over groups with the place of the first pass (null: none): solved, pass@1, top-k, MRR and the like."""
    n = F.count("*")
    solved = F.count_if(first.isNotNull())
    return [
        n.alias("groups"),
        solved.alias("solved"),
        F.count_if(first == 1).alias("pass_at_1"),
        F.count_if(first <= k).alias("pass_at_k"),
        ratio0(F.count_if(first == 1), n).alias("pass_at_1_rate"),
        ratio0(F.sum(F.coalesce(1.0 / first, F.lit(0.0))), n).alias("mrr"),
        ratio0(F.coalesce(F.sum(1.0 / first), F.lit(0.0)), solved).alias("mrr_solved"),
        F.round(F.avg(first), 6).alias("avg_first"),
        F.round(F.avg(F.coalesce(first - 1, size)), 6).alias("avg_before"),
        (solved - F.count_if(first == 1)).alias("residual"),
    ]


def sigmoid(x: Column) -> Column:
    """1 / (1 + e^-x) without overflow."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def calibration(df: DataFrame, probability: Column, outcome: Column, buckets: int = 5) -> DataFrame:
    """Equal-width buckets of the probability, empty ones kept: rows, mean probability, rate, and the share of the
    expected calibration error; rows without a probability or an outcome are left out."""
    p = df.select(probability.alias("p"), outcome.cast("int").alias("y")).where(F.col("p").isNotNull() & ~F.isnan("p") & F.col("y").isNotNull())
    b = p.groupBy(F.least(F.floor(F.col("p") * buckets), F.lit(buckets - 1)).cast("int").alias("bucket")).agg(
        F.count("*").alias("n"), F.avg("p").alias("ap"), F.avg("y").alias("ay"), F.sum((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("sq")
    )
    total = b.agg(F.sum("n").alias("total"))
    every = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return (
        every.join(F.broadcast(b), "bucket", "left")  # at most ``buckets`` rows
        .join(F.broadcast(total), F.lit(True), "left")
        .select(
            F.col("bucket").cast("long").alias("bucket"),
            F.coalesce("n", F.lit(0)).alias("n"),
            F.round("ap", 6).alias("mean_probability"),
            F.round("ay", 6).alias("rate"),
            ratio0(F.col("n") * F.abs(F.col("ay") - F.col("ap")), F.col("total")).alias("ece_part"),
            ratio0(F.col("sq"), F.col("total")).alias("brier_part"),
        )
    )


def confusion(df: DataFrame, expected: Column, predicted: Column) -> DataFrame:
    return df.groupBy(expected.alias("expected"), predicted.alias("predicted")).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    """Value counts of several fields in one pass; array fields count their elements."""
    def entries(name: str, c: Column) -> Column:
        values = c if isinstance(df.select(c).schema[0].dataType, T.ArrayType) else F.array(c.cast("string"))
        return F.transform(F.coalesce(values, F.array()), lambda v: F.struct(F.lit(name).alias("field"), v.cast("string").alias("value")))

    parts = [entries(name, c) for name, c in fields.items()]
    return df.select(F.explode(F.concat(*parts)).alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def centroids(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Mean vector of each group, element by element: partial sums by (group, place), so no vectors are gathered."""
    long = df.select(*keys, F.posexplode(vector).alias("i", "v"))
    return long.groupBy(*keys, "i").agg(F.round(F.avg("v"), 6).alias("mean"), F.count("v").alias("n"))


def majority(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """The most frequent label of each group; ties go to the smallest."""
    n = df.groupBy(*keys, label).agg(F.count("*").alias("n"))
    top = n.groupBy(*keys).agg(F.max("n").alias("m"))
    return n.join(top, list(keys)).where(F.col("n") == F.col("m")).groupBy(*keys).agg(F.min(label).alias("majority"), F.first("m").alias("n"))
