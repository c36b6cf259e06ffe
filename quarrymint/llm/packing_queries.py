"""Problem 7: documents in containers of 2,048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrymint.llm.packing import fill_report, pack
from quarrymint.llm.tokens import spread, token_counts
from quarrymint.session import cut, read

CAPACITY = 2048


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text"), spark.sparkContext.defaultParallelism)
    sizes = cut(token_counts(docs, "doc_id", "text"), "packing-sizes")
    return pack(sizes, "doc_id", "n_tokens", CAPACITY)


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(_packed(spark, sf_dir), CAPACITY)


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill}
#: Token counts and packing are not expressible in SQL: tests check capacity, wholeness and fill.
ORACLE: dict[str, str] = {}
