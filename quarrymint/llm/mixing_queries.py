"""Problem 8: documents mixed to the shares of source_targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrymint.llm.mixing import mix
from quarrymint.llm.tokens import spread, token_counts
from quarrymint.session import cut, read


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), spark.sparkContext.defaultParallelism)
    sizes = cut(token_counts(docs, "doc_id", "text", ["source"]), "mixing-sizes")
    return mix(sizes, "doc_id", "source", "n_tokens", read(spark, sf_dir, "source_targets"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


QUERIES = {"p8_mixture": p8_mixture, "p8_shares": p8_shares}
#: Token counts are not expressible in SQL: tests check shares, repeats and nesting against brute force.
ORACLE: dict[str, str] = {}
