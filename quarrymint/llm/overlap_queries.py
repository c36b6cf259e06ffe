"""Problem 5: evaluation tasks whose prompt also occurs, the same or almost the same, in training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymint.llm.overlap import member_pairs, overlap_counts, similar_across
from quarrymint.session import read

LEAST = 0.75


def _side():
    split = _split()
    return F.when(split == "train", "train").when(split.isin("validation", "val", "dev", "test"), "eval")


def _split():
    return F.lower(F.regexp_replace("split", r"^\s+|\s+$", ""))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, members = similar_across(read(spark, sf_dir, "tasks"), "task_id", "prompt", _side(), LEAST)
    p = member_pairs(pairs, members, "task_id").where(F.col("eval_id") != F.col("train_id"))
    return p.select(F.least("eval_id", "train_id").alias("task_id_a"), F.greatest("eval_id", "train_id").alias("task_id_b")).distinct()


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation split and source_type: tasks, tasks that overlap training, and pairs."""
    by = ["eval_split", "source_type"]
    tasks = read(spark, sf_dir, "tasks")
    whole = tasks.where(_side() == "eval").select("task_id", _split().alias("eval_split"), "source_type").distinct().groupBy(*by).agg(F.count("*").alias("tasks"))
    pairs, members = similar_across(tasks, "task_id", "prompt", _side(), LEAST, {"eval_split": _split(), "source_type": F.col("source_type")})
    zero = F.lit(0).cast("long")
    counts = whole.withColumn("overlapping", zero).withColumn("pairs", zero).unionByName(overlap_counts(pairs, members, by).withColumn("tasks", zero))
    return counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tasks", "overlapping", "pairs")])


QUERIES = {"p5_found": p5_found, "p5_counts": p5_counts}

_BASE = r"""
WITH once AS (SELECT DISTINCT task_id, source_type, lower(regexp_replace(split, '^\s+|\s+$', '', 'g')) AS s,
  list_distinct(regexp_extract_all(lower(prompt), '[a-z0-9_]+')) AS w FROM tasks),
e AS (SELECT * FROM once WHERE s IN ('validation', 'val', 'dev', 'test')),
t AS (SELECT * FROM once WHERE s = 'train' AND len(w) > 0),
p AS (SELECT e.task_id AS a, t.task_id AS b FROM e JOIN t ON len(e.w) > 0 AND len(list_intersect(e.w, t.w)) * 1.0 >= 0.75 * (len(e.w) + len(t.w) - len(list_intersect(e.w, t.w))))
"""
ORACLE = {
    "p5_found": _BASE + "SELECT DISTINCT least(a, b) AS task_id_a, greatest(a, b) AS task_id_b FROM p WHERE a <> b",
    "p5_counts": _BASE
    + """SELECT s AS eval_split, source_type, count(*) AS tasks, count(n) AS overlapping, coalesce(sum(n), 0)::BIGINT AS pairs
FROM e LEFT JOIN (SELECT a, count(DISTINCT b) AS n FROM p GROUP BY a) h ON h.a = e.task_id GROUP BY 1, 2""",
}
