"""Problem 1: the transitions whose prompt embeddings are most similar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymint.llm.neighbours import nearest
from quarrymint.session import read

K, LEAST = 5, 0.90


def _near(spark: SparkSession, sf_dir: str, least: float, report: dict | None = None) -> DataFrame:
    df = read(spark, sf_dir, "prompt_repo_transitions")
    return nearest(df, "id", F.col("prompt_context.embedding"), F.col("prompt_jepa_target.embedding_dim"), K, least, report=report)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _near(spark, sf_dir, LEAST)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five transitions of similarity 0.90 or more for every transition, with similarity and rank."""
    return _near(spark, sf_dir, LEAST)


def p1_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each length: vectors, leaves, the calibrated number of leaves visited and the recall reached on the probes."""
    report: dict = {}
    _near(spark, sf_dir, LEAST, report)
    rows = [(d, r["vectors"], r["leaves"], r["visits"], r["recall"]) for d, r in report.items()]
    return spark.createDataFrame(rows, "dim int, vectors long, leaves long, visits long, recall double")


QUERIES = {"p1_found": p1_found, "p1_neighbours": p1_neighbours, "p1_recall": p1_recall}

ORACLE = {
    "p1_found": """
WITH once AS (SELECT DISTINCT id, prompt_context.embedding AS v, prompt_jepa_target.embedding_dim AS d FROM prompt_repo_transitions),
ok AS (SELECT * FROM once WHERE len(v) = d AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (SELECT a.id AS q, b.id AS n, round(list_cosine_similarity(a.v, b.v), 6) AS s FROM ok a JOIN ok b ON a.d = b.d AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, n) AS k FROM p)
SELECT DISTINCT least(q, n) AS id_a, greatest(q, n) AS id_b FROM r WHERE k <= 5 AND s >= 0.90
"""
}
