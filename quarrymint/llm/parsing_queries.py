"""Problem 3: sources of mined transitions that do not parse, and their rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymint.llm.parsing import check_sources, rates
from quarrymint.session import read

SIDES = (("before", "before_source"), ("after", "after_source"))


def _checked(spark: SparkSession, sf_dir: str, carry: tuple[str, ...] = ()) -> DataFrame:
    return check_sources(read(spark, sf_dir, "mined_git_transitions"), "transition_id", "file_path", SIDES, carry)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).where(~F.col("valid")).select("transition_id", "side").distinct()


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(_checked(spark, sf_dir, ("repo",)), "transition_id", ["repo", "language"])


QUERIES = {"p3_found": p3_found, "p3_rates": p3_rates}
#: Grammars are not expressible in SQL: tests compare with the languages' own parsers and with hand-made files.
ORACLE: dict[str, str] = {}
