"""Where callers plug in: predictors as functions on frames, ranking strategies as orders of columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymint.operators.ranking import top_k
from quarrymint.operators.rollup import ratio

Predictor = Callable[[DataFrame], DataFrame]


def evaluate_predictions(rows: DataFrame, key: str, expected: Mapping[str, Column], predictor: Predictor) -> tuple[DataFrame, DataFrame]:
    """Accuracy (field, total, correct, accuracy; field ``(row)`` for rows of which all fields are right) and the mismatches
    (``key``, field, expected, predicted).

    ``predictor`` takes the rows and gives ``key`` and a column for each field of ``expected``; a row without a prediction,
    or a field without a column, counts as predicted null. Null equals null. Values are compared as text.
    """
    guessed = predictor(rows)
    have = [f for f in expected if f in guessed.columns]
    guessed = guessed.select(F.col(key).alias("__key"), *[F.col(f).cast("string").alias(f"p_{f}") for f in have]).dropDuplicates(["__key"])
    wanted = rows.select(F.col(key).alias("__key"), *[c.cast("string").alias(f"e_{f}") for f, c in expected.items()])
    both = wanted.join(guessed, "__key", "left")
    predicted = {f: F.col(f"p_{f}") if f in have else F.lit(None).cast("string") for f in expected}
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"e_{f}").alias("expected"), p.alias("predicted"), F.col(f"e_{f}").eqNullSafe(p).alias("ok")) for f, p in predicted.items()])
    judged = both.select("__key", cells.alias("cells"))
    whole = F.struct(F.lit("(row)").alias("field"), F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("predicted"), F.forall("cells", lambda c: c["ok"]).alias("ok"))
    each = judged.select("__key", F.explode(F.concat("cells", F.array(whole))).alias("c")).select("__key", "c.*")
    right = F.count_if("ok")
    accuracy = each.groupBy("field").agg(F.count("*").alias("total"), right.alias("correct"), ratio(right, F.count("*")).alias("accuracy"))
    misses = each.where(~F.col("ok") & (F.col("field") != "(row)")).select(F.col("__key").alias(key), "field", "expected", "predicted")
    return accuracy, misses


def ranked_by(rows: DataFrame, group: Sequence[str], strategies: Mapping[str, Sequence[Column]], k: int) -> DataFrame:
    """The first ``k`` rows of every group under each strategy, with ``strategy`` and ``place``; orders must be total."""
    return reduce(DataFrame.unionByName, [top_k(rows, group, order, k, "place").withColumn("strategy", F.lit(name)) for name, order in strategies.items()])
