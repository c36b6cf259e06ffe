"""Small deterministic learners: fixed-weight scoring, pairwise margin ranking, token perceptrons."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most training rows that a sequential fit takes (by hash of the key): it runs in one task by its nature.
FIT_ROWS = 100_000


def bounded_rows(df: DataFrame, key: str, rows: int = FIT_ROWS) -> DataFrame:
    """At most about ``rows`` rows, chosen by the hash of the key alone; all rows where there are no more."""
    total = df.count()
    share = 1.0 if total <= rows else rows / total
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else df


def linear_score(features: DataFrame, key: str, weights: Mapping[str, float], bias: float = 0.0) -> DataFrame:
    """(key, score): bias + sum of weight * value over long features (key, name, value); unknown names weigh nothing."""
    w = F.create_map(*[x for n, v in weights.items() for x in (F.lit(n), F.lit(float(v)))]) if weights else F.create_map().cast("map<string,double>")
    return features.groupBy(key).agg(F.round(F.sum(F.coalesce(F.element_at(w, F.col("name")), F.lit(0.0)) * F.col("value")) + bias, 6).alias("score"))


def fit_pairwise(pairs: DataFrame, key: str, names: list[str], epochs: int = 8, rate: float = 0.25, margin: float = 1.0) -> dict[str, float]:
    """Weights of a margin ranker over pairs (``key``, array<double> ``diff`` = positive - negative features), taken in
    the order of ``key``: for each pair whose score does not exceed the margin, weights move by rate * diff. The pairs are
    bounded by FIT_ROWS and the fit is one sequential pass an epoch, in one task behind a shuffle of these rows alone."""

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*parts, pd.DataFrame({"k": [], "diff": []})]).sort_values("k")["diff"]
        x = np.stack([np.asarray(d, dtype=float) for d in rows]) if len(rows) else np.zeros((0, len(names)))
        w = np.zeros(len(names))
        for _ in range(epochs):
            for d in x:
                if w @ d <= margin:
                    w += rate * d
        yield pd.DataFrame({"name": names, "weight": w})

    some = bounded_rows(pairs, key).select(F.col(key).alias("k"), "diff").repartition(1)
    return {r["name"]: r["weight"] for r in some.mapInPandas(fit, "name string, weight double").collect() if abs(r["weight"]) >= 1e-12}


def fit_perceptron(df: DataFrame, key: str, tokens: Column, label: Column, epochs: int = 10) -> DataFrame:
    """(label, token, weight) of a multiclass perceptron, rows in the order of ``key``; ties go to the largest label. All
    (label, token) weights are one matrix, so a row costs one gather and one sum."""

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*parts, pd.DataFrame({"k": [], "t": [], "y": []})]).sort_values("k")
        labels = sorted(set(rows["y"]))
        place: dict = {}
        cells = [np.array([place.setdefault(x, len(place)) for x in t], dtype=np.int64) for t in rows["t"]]
        wanted = np.array([labels.index(y) for y in rows["y"]], dtype=np.int64)
        w = np.zeros((len(labels), len(place)))
        for _ in range(epochs if len(labels) > 1 else 0):
            wrong = 0
            for t, y in zip(cells, wanted, strict=True):
                s = w[:, t].sum(axis=1)
                guess = len(labels) - 1 - int(np.argmax(s[::-1]))
                if guess != y:
                    wrong += 1
                    w[y, t] += 1
                    w[guess, t] -= 1
            if not wrong:
                break
        names = list(place)
        at_label, at_token = np.nonzero(w)
        yield pd.DataFrame({"label": [labels[i] for i in at_label], "token": [names[i] for i in at_token], "weight": w[at_label, at_token]}, columns=["label", "token", "weight"])

    some = bounded_rows(df.where(label.isNotNull()), key).select(F.col(key).alias("k"), F.array_distinct(tokens).alias("t"), label.alias("y")).repartition(1)
    return some.mapInPandas(fit, "label string, token string, weight double")


def predict(weights: DataFrame, df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, predicted): the label with the largest sum of weights; ties, and rows of unknown tokens, go to the largest
    label. A label of which a row has no token scores 0: only the largest such label can win, so each row gets that one,
    and no rows x labels are made."""
    long = df.select(F.col(key), F.explode(F.array_distinct(tokens)).alias("token"))
    sums = long.join(weights, "token").groupBy(key, "label").agg(F.sum("weight").alias("s"))
    scored = sums.groupBy(key).agg(F.max_by("label", F.struct("s", "label")).alias("best"), F.max("s").alias("s"), F.collect_set("label").alias("seen"))  # at most one a label
    labels = weights.agg(F.array_sort(F.collect_set("label")).alias("labels"))  # one row, as long as there are labels
    rows = df.select(key).join(scored, key, "left").join(F.broadcast(labels), F.lit(True))
    rest = F.array_max(F.when(F.col("seen").isNull(), F.col("labels")).otherwise(F.array_except("labels", "seen")))
    zero = F.col("s").isNull() | (rest.isNotNull() & ((F.col("s") < 0) | ((F.col("s") == 0) & (rest > F.col("best")))))
    return rows.select(key, F.when(zero, rest).otherwise(F.col("best")).alias("predicted"))
