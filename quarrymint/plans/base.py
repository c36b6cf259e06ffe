"""Shared inputs of the reference operators' queries, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymint.operators.ranking import order_key
from quarrymint.session import read


def nonblank(c: str) -> Column:
    return F.when(~F.col(c).rlike(r"^\s*$"), F.col(c))


def outcomes(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """candidate_outcomes with each candidate once, its plan key (task, ph, plan) and the columns asked for."""
    df = read(spark, sf_dir, "candidate_outcomes")
    cols = dict.fromkeys(("rank_index", "passed", *columns))
    picked = df.select("candidate_id", "task", F.coalesce("phase", F.lit("ranked")).alias("ph"), nonblank("repair_plan_id").alias("plan"), *cols)
    return picked.dropDuplicates(["candidate_id"])


PLAN = ["task", "ph", "plan"]


def group_text(*columns: str) -> Column:
    """One text for a group of values, so that null is a value too and the group can be joined on."""
    return F.to_json(F.struct(*columns))


def ORDER() -> Column:  # noqa: N802
    """Rank order within a plan; a function, since columns need a session and these modules are imported without one."""
    return order_key("rank_index", "candidate_id")


def sort_order() -> list[Column]:
    return [F.col("rank_index").asc_nulls_last(), F.col("candidate_id").asc()]


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "tasks").dropDuplicates(["task_id"])


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "prompt_repo_transitions").dropDuplicates(["id"])


#: Common table expressions of the SQL side: c, candidates once; t, tasks once; tr, transitions once.
C = """c AS (SELECT *, coalesce(phase, 'ranked') AS ph, CASE WHEN regexp_full_match(repair_plan_id, '\\s*') THEN NULL ELSE repair_plan_id END AS plan,
  coalesce(rank_index, 4611686018427387904) AS rk FROM candidate_outcomes QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY ingested_at) = 1)"""
O = "o AS (SELECT *, row_number() OVER (PARTITION BY task, ph, plan ORDER BY rk, candidate_id) AS pos FROM c)"  # noqa: E741
T = "t AS (SELECT * FROM tasks QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY ingested_at) = 1)"
TR = "tr AS (SELECT * FROM prompt_repo_transitions QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at) = 1)"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(queries: dict, oracle: dict, name: str, sql: str | None = None):
    """Decorator: enter a query, and its SQL if it has one."""

    def enter(f):
        queries[name] = f
        if sql:
            oracle[name] = sql
        return f

    return enter
