"""Problem 6: nested hints, assertions, ranks and outcomes as flat rows that name their parent and place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymint.operators.nested import child_table, has_path, parse_json_lines
from quarrymint.session import read

EMPTY = "child string, parent_key string, outer_pos long, inner_pos long"
#: What the cases need of a log line, so that no line can change how the others are read.
_ASSERTION = T.StructType([T.StructField("expected", T.StringType())])
_HINT = T.StructType([T.StructField("assertions", T.ArrayType(_ASSERTION))])
LOG = T.StructType([T.StructField("failure_hints", T.ArrayType(_HINT))])


def _cases(child: str, table: DataFrame) -> DataFrame:
    two = F.col("positions")
    return table.select(
        F.lit(child).alias("child"),
        F.col("root_key").alias("parent_key"),
        two[0].alias("outer_pos"),
        F.when(F.size(two) > 1, two[F.size(two) - 1]).otherwise(F.lit(0)).cast("long").alias("inner_pos"),
    )


def _assertions(child: str, df: DataFrame, key: str) -> DataFrame:
    path = ("failure_hints", "assertions")
    if not has_path(df.schema, (*path, "expected")):
        return df.sparkSession.createDataFrame([], EMPTY)
    return _cases(child, child_table(df, key, path).where(F.col("expected").isNotNull()))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four kinds of cases. A row delivered again has the same places in the same parent, so the union is made
    distinct: only (key, place) rows are shuffled, never the nested values."""
    candidates = read(spark, sf_dir, "candidate_outcomes")
    transitions = read(spark, sf_dir, "prompt_repo_transitions")
    log = parse_json_lines(read(spark, sf_dir, "outcome_log"), "line_id", "line", hoist=("record",), want=LOG)
    overlap = child_table(candidates, "candidate_id", ("overlapping_candidate_ranks",)).where(F.col("value").isNotNull())
    outcome = transitions.where(F.length(F.trim(F.regexp_replace("outcome.status", r"\s+", " "))) > 0).select(
        F.lit("outcome").alias("child"), F.col("id").alias("parent_key"), F.lit(0).cast("long").alias("outer_pos"), F.lit(0).cast("long").alias("inner_pos")
    )
    return (
        _assertions("assertion", candidates, "candidate_id")
        .unionByName(_cases("overlap", overlap))
        .unionByName(outcome)
        .unionByName(_assertions("log_assertion", log, "line_id"))
        .distinct()
    )


def p6_hint_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each exception type of the hints in candidate_outcomes: hints and distinct candidates that have one."""
    candidates = read(spark, sf_dir, "candidate_outcomes")
    hints = child_table(candidates, "candidate_id", ("failure_hints",)).where(F.col("exception_type").isNotNull())
    once = hints.select("root_key", "ordinal", "exception_type").distinct()
    return once.groupBy("exception_type", "root_key").agg(F.count("*").alias("n")).groupBy("exception_type").agg(F.sum("n").alias("hints"), F.count("*").alias("candidates"))


QUERIES = {"p6_found": p6_found, "p6_hint_counts": p6_hint_counts}

#: The log half follows the shapes by DuckDB's JSON type: text is decoded, a lone object is a list of one.
_DECODE = "CASE WHEN json_type({0}) = 'VARCHAR' AND json_valid({0} ->> '$') THEN ({0} ->> '$')::JSON ELSE {0} END"
_LIST = "CASE json_type({0}) WHEN 'ARRAY' THEN {0}::JSON[] WHEN 'OBJECT' THEN [{0}] ELSE [] END"
ORACLE = {
    "p6_found": f"""
WITH h AS (SELECT DISTINCT candidate_id, generate_subscripts(failure_hints, 1) AS o, unnest(failure_hints) AS hint FROM candidate_outcomes),
a AS (SELECT candidate_id, o, generate_subscripts(hint.assertions, 1) AS i, unnest(hint.assertions) AS x FROM h),
v AS (SELECT DISTINCT candidate_id, generate_subscripts(overlapping_candidate_ranks, 1) AS o, unnest(overlapping_candidate_ranks) AS x FROM candidate_outcomes),
l0 AS (SELECT DISTINCT line_id, line::JSON AS j FROM outcome_log WHERE json_valid(line)),
l1 AS (SELECT line_id, {_DECODE.format('j')} AS j FROM l0),
l2 AS (SELECT line_id, CASE WHEN coalesce(json_type(j, '$.failure_hints'), 'NULL') <> 'NULL' THEN j -> '$.failure_hints'
  ELSE ({_DECODE.format("(j -> '$.record')")}) -> '$.failure_hints' END AS hs FROM l1 WHERE json_type(j) = 'OBJECT'),
l3 AS (SELECT line_id, {_DECODE.format('hs')} AS hs FROM l2),
l4 AS (SELECT line_id, {_LIST.format('hs')} AS hs FROM l3),
l5 AS (SELECT line_id, generate_subscripts(hs, 1) AS o, unnest(hs) AS hint FROM l4),
l6 AS (SELECT line_id, o, {_DECODE.format('hint')} AS hint FROM l5),
l7 AS (SELECT line_id, o, hint -> '$.assertions' AS asr FROM l6 WHERE json_type(hint) = 'OBJECT'),
l8 AS (SELECT line_id, o, {_DECODE.format('asr')} AS asr FROM l7),
l9 AS (SELECT line_id, o, {_LIST.format('asr')} AS asr FROM l8),
l10 AS (SELECT line_id, o, generate_subscripts(asr, 1) AS i, unnest(asr) AS x FROM l9),
l11 AS (SELECT line_id, o, i, {_DECODE.format('x')} AS x FROM l10)
SELECT 'assertion' AS child, candidate_id::VARCHAR AS parent_key, o::BIGINT AS outer_pos, i::BIGINT AS inner_pos FROM a WHERE x.expected IS NOT NULL
UNION SELECT 'overlap', candidate_id::VARCHAR, o::BIGINT, 0::BIGINT FROM v WHERE x IS NOT NULL
UNION SELECT 'outcome', id, 0::BIGINT, 0::BIGINT FROM prompt_repo_transitions WHERE length(trim(regexp_replace(outcome.status, '\\s+', ' ', 'g'))) > 0
UNION SELECT 'log_assertion', line_id::VARCHAR, o::BIGINT, i::BIGINT FROM l11 WHERE coalesce(json_type(x -> '$.expected'), 'NULL') <> 'NULL'
""",
    "p6_hint_counts": """
WITH h AS (SELECT DISTINCT candidate_id, generate_subscripts(failure_hints, 1) AS o, unnest(failure_hints) AS hint FROM candidate_outcomes)
SELECT hint.exception_type AS exception_type, count(*)::BIGINT AS hints, count(DISTINCT candidate_id) AS candidates FROM h WHERE hint.exception_type IS NOT NULL GROUP BY 1
""",
}
