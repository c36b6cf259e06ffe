"""Problem 4: tasks that share a family or a name get one split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymint.llm.components import deal_splits, linked_groups
from quarrymint.session import read


def _letters(column: str):
    """The ASCII letters and digits in lower case; null where there are none."""
    return F.nullif(F.lower(F.regexp_replace(column, "[^A-Za-z0-9]", "")), F.lit(""))


def _groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    family = _letters("family")
    return linked_groups(read(spark, sf_dir, "tasks"), "task_id", [_letters("name"), F.when(family != "unclassified", family)])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, _ = _groups(spark, sf_dir)
    return groups.where(F.col("root") < F.col("node")).select(F.col("root").alias("root_task_id"), F.col("node").alias("task_id"))


def p4_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of the spanning forest: one less than tasks in every group."""
    _, forest = _groups(spark, sf_dir)
    return forest.select(F.col("a").alias("task_id_a"), F.col("b").alias("task_id_b"))


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, _ = _groups(spark, sf_dir)
    out = deal_splits(groups, read(spark, sf_dir, "split_targets"))
    return out.select(F.col("node").alias("task_id"), F.col("root").alias("root_task_id"), "split")


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, groups and share of each split beside its target."""
    splits = p4_splits(spark, sf_dir)
    per = splits.groupBy("split", "root_task_id").agg(F.count("*").alias("n")).groupBy("split").agg(F.sum("n").alias("tasks"), F.count("*").alias("groups"))
    total = per.agg(F.sum("tasks").alias("all_tasks"))
    goals = read(spark, sf_dir, "split_targets")
    return (
        goals.join(per, "split", "left")
        .join(F.broadcast(total), F.lit(True))
        .select("split", "target_share", F.coalesce("tasks", F.lit(0)).alias("tasks"), F.coalesce("groups", F.lit(0)).alias("groups"), F.round(F.coalesce("tasks", F.lit(0)) / F.col("all_tasks"), 6).alias("share"))
    )


QUERIES = {"p4_found": p4_found, "p4_forest": p4_forest, "p4_splits": p4_splits, "p4_shares": p4_shares}

ORACLE = {
    "p4_found": r"""
WITH RECURSIVE once AS (SELECT DISTINCT task_id, lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) AS n, lower(regexp_replace(family, '[^A-Za-z0-9]', '', 'g')) AS f FROM tasks),
links AS (SELECT 'n' || n AS k, task_id FROM once WHERE n <> '' UNION SELECT 'f' || f, task_id FROM once WHERE f <> '' AND f <> 'unclassified'),
stars AS (SELECT task_id AS b, min(task_id) OVER (PARTITION BY k) AS a FROM links),
edges AS (SELECT a, b FROM stars UNION SELECT b, a FROM stars),
reach(node, root) AS (SELECT task_id, task_id FROM once UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node WHERE r.root < e.b)
SELECT min(root) AS root_task_id, node AS task_id FROM reach GROUP BY node HAVING min(root) < node
"""
}
