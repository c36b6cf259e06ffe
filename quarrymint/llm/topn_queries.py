"""Problem 2: the best candidates of every repair plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymint.llm.topn import top_n
from quarrymint.session import read

TIES = (("failure_hint_score", "desc"), ("rank_index", "asc"))


def _top(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    df = read(spark, sf_dir, "candidate_outcomes")
    plan = F.when(~F.col("repair_plan_id").rlike(r"^\s*$"), F.col("repair_plan_id"))
    group = [F.col("task"), F.coalesce("phase", F.lit("ranked")), plan]
    return top_n(df, group, "model_score", TIES, "candidate_id", n)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, 3).select("candidate_id")


def p2_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups have 1, 2, ... 5 items among their first five."""
    return _top(spark, sf_dir, 5).groupBy("group_key").agg(F.max("rank").cast("long").alias("kept")).groupBy("kept").agg(F.count("*").alias("groups"))


QUERIES = {"p2_found": p2_found, "p2_group_sizes": p2_group_sizes}

_RANKED = """
WITH once AS (SELECT DISTINCT candidate_id, task, coalesce(phase, 'ranked') AS phase,
  CASE WHEN regexp_full_match(repair_plan_id, '\\s*') THEN NULL ELSE repair_plan_id END AS plan,
  CASE WHEN isnan(model_score) THEN NULL ELSE model_score END AS s,
  CASE WHEN isnan(failure_hint_score) THEN NULL ELSE failure_hint_score END AS h, rank_index FROM candidate_outcomes),
r AS (SELECT *, row_number() OVER (PARTITION BY task, phase, plan
  ORDER BY s DESC NULLS LAST, h DESC NULLS LAST, rank_index ASC NULLS LAST, candidate_id) AS rank FROM once)
"""
ORACLE = {
    "p2_found": _RANKED + "SELECT candidate_id FROM r WHERE rank <= 3",
    "p2_group_sizes": _RANKED
    + "SELECT kept, count(*) AS groups FROM (SELECT max(rank) AS kept FROM r WHERE rank <= 5 GROUP BY task, phase, plan) GROUP BY kept",
}
