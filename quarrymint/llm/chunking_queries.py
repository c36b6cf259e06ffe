"""Problem 9: pieces of the documents of more than 1,024 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymint.llm.chunking import split_oversized
from quarrymint.session import read

LIMIT, OVERLAP = 1024, 64


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(read(spark, sf_dir, "documents"), "doc_id", "text", LIMIT, OVERLAP)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a case when the operator cuts it."""
    return _pieces(spark, sf_dir).where(F.col("piece_no") == 1).select("doc_id").distinct()


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir)


def p9_cut_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the pieces end, and their mean fill."""
    return _pieces(spark, sf_dir).groupBy("cut").agg(F.count("*").alias("pieces"), F.round(F.avg(F.col("n_tokens") / LIMIT), 6).alias("mean_fill"))


QUERIES = {"p9_found": p9_found, "p9_pieces": p9_pieces, "p9_cut_kinds": p9_cut_kinds}
#: Tokens are not expressible in SQL: tests compare with a brute-force greedy cut and check the round trip.
ORACLE: dict[str, str] = {}
