"""Vector retrieval: hashed text encoders, blocked exact kNN, nearest-delta and prototype scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymint.functions.hashing import signed_bucket

#: Most bytes of query vectors that are sent to every task at once; more queries go in several blocks.
QUERY_BYTES = 16 << 20
#: Most bytes of one matrix of scores; more points are compared in several slices.
SCORE_BYTES = 32 << 20


def encode_text(df: DataFrame, key: str, tokens: Column, dim: int, log: bool = True) -> DataFrame:
    """(key, v): unit vectors of signed hashed token counts, log1p-weighted unless ``log`` is off. Built in long form, so only
    (row, bucket, count) rows are shuffled; a row without tokens has a zero vector."""
    b, s = signed_bucket(F.col("token"), dim)
    long = df.select(F.col(key), F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    cells = long.select(key, b.alias("b"), (s * (F.log1p("n") if log else F.col("n"))).alias("x")).groupBy(key, "b").agg(F.sum("x").alias("x"))
    packed = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("b", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))  # at most ``dim`` cells
    filled = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)) / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0))
    zero = F.array_repeat(F.lit(0.0), dim)
    return df.select(key).distinct().join(packed.select(key, filled.alias("v")), key, "left").select(key, F.coalesce("v", zero).alias("v"))


def knn(points: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", ties: str = "asc", exclude_self: bool = True) -> DataFrame:
    """Exact k nearest ``points`` (id, v) of every query (id, v): (query, id, score), scores rounded to 6 decimals.

    ``metric`` is cosine or dot (higher is nearer) or euclidean (lower is nearer). Ties go by id, ``asc`` or ``desc``.
    The query set is collected in blocks of at most QUERY_BYTES and compared with all points by matrix products; each
    task keeps k candidates for each query, so what is shuffled follows the queries, not the points. Every length of
    vectors has blocks of its own: a query is compared with the points of its length. Null and empty vectors have no
    neighbours.
    """
    spark = points.sparkSession
    sign = 1.0 if metric == "euclidean" else -1.0
    kind = points.schema["id"].dataType.simpleString()
    found: DataFrame | None = None

    def compare(q_ids: list, q: np.ndarray):
        norm_q = np.linalg.norm(q, axis=1)

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: tuple | None = None
            step = max(1, SCORE_BYTES // (8 * len(q)))
            for part in (some.iloc[at : at + step] for some in parts for at in range(0, len(some), step)):
                part = part.sort_values("id", ascending=ties == "asc")
                p, ids = np.stack(part["v"].to_numpy()).astype(float), part["id"].to_numpy()
                s = q @ p.T
                if metric == "cosine":
                    n = norm_q[:, None] * np.linalg.norm(p, axis=1)[None, :]
                    s = np.where(n > 1e-12, s / np.where(n > 1e-12, n, 1.0), 0.0)
                elif metric == "euclidean":
                    s = np.sqrt(np.maximum(0.0, (q * q).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * s))
                s = np.round(s, 6) + 0.0
                top = np.argsort(sign * s, axis=1, kind="stable")[:, : k + 1]
                s, ids = np.take_along_axis(s, top, 1), ids[top]
                if best is not None:
                    s, ids = np.hstack([best[0], s]), np.hstack([best[1], ids])
                    place = np.unique(ids, return_inverse=True)[1].reshape(ids.shape)
                    top = np.lexsort((place if ties == "asc" else -place, sign * s), axis=1)[:, : k + 1]
                    s, ids = np.take_along_axis(s, top, 1), np.take_along_axis(ids, top, 1)
                best = s, ids
            if best is not None:
                out = pd.DataFrame({"query": np.repeat(np.array(q_ids, dtype=best[1].dtype), best[1].shape[1]), "id": best[1].ravel(), "score": best[0].ravel()})
                yield out[out["query"] != out["id"]] if exclude_self else out

        return run

    queries = queries.select("id", "v").where(F.size("v") > 0)
    for n, total in sorted(tuple(r) for r in queries.groupBy(F.size("v")).count().collect()):
        blocks = max(1, -(-total * n * 8 // QUERY_BYTES))
        for b in range(blocks):
            some = queries.where((F.size("v") == n) & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)).toPandas()
            if len(some):
                part = points.select("id", "v").where(F.size("v") == n).mapInPandas(compare(some["id"].tolist(), np.stack(some["v"].to_numpy()).astype(float)), f"query {kind}, id {kind}, score double")
                found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], f"query {kind}, id {kind}, score double")
    near = F.asc("score") if metric == "euclidean" else F.desc("score")
    w = Window.partitionBy("query").orderBy(near, F.asc("id") if ties == "asc" else F.desc("id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def prototype_score(parts: list[tuple[float, Column]]) -> Column:
    """Weighted mean of the scores that are there, weights renormalized; -1 where none is."""
    top = sum((F.when(s.isNotNull(), s * w).otherwise(0.0) for w, s in parts), F.lit(0.0))
    bottom = sum((F.when(s.isNotNull(), w).otherwise(0.0) for w, s in parts), F.lit(0.0))
    return F.round(F.coalesce(F.try_divide(top, bottom), F.lit(-1.0)), 6)
