"""Queries of recursive walks, lexical variants, BLAKE2b features, syntax deltas, readers and pluggable predictors."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from quarrymint.functions.python_udfs import ast_features, blake2b_cell, blake2b_tenth
from quarrymint.functions.text import lexical_tokens, tokens
from quarrymint.operators.extension import evaluate_predictions, ranked_by
from quarrymint.operators.trees import flat_features, json_nodes, keys_found, numbers_of
from quarrymint.plans.base import PLAN, TR, C, T, outcomes, register, sort_order, tasks, transitions
from quarrymint.session import read, scratch_path
from quarrymint.sources.jsonl import read_commented, source_tree

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = partial(register, QUERIES, ORACLE)

#: Every node of the log lines; a path in the operator's form: [] for places.
_NODES = r"""n AS (SELECT l.line_id, t.key AS name, t.type AS kind, t.fullkey LIKE '%]' AS in_array, 'line' || regexp_replace(substr(t.fullkey, 2), '\[\d+\]', '[]', 'g') AS path, t.value
FROM (SELECT DISTINCT line_id, line FROM outcome_log WHERE json_valid(line)) l, json_tree(l.line) t)"""
_NUMBER = "kind IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT')"


def _nodes(spark, sf):
    lines = read(spark, sf, "outcome_log").select("line_id", "line").dropDuplicates(["line_id"])
    return json_nodes(lines, "line_id", "line", "line")


@query("x05_flat_features", f"""WITH {_NODES}, v AS (SELECT *, CASE kind WHEN 'NULL' THEN 'null' ELSE value ->> '$' END AS s FROM n), f AS (
SELECT path || ':present' AS feature FROM v WHERE NOT in_array AND path <> 'line' UNION ALL SELECT path || ':len=' || json_array_length(value) FROM v WHERE kind = 'ARRAY'
UNION ALL SELECT CASE WHEN in_array THEN path[:-3] || ':item=' || s ELSE path || '=' || s END FROM v WHERE kind NOT IN ('ARRAY', 'OBJECT')) SELECT feature, count(*) AS n FROM f GROUP BY feature""")
def x05(spark, sf):
    """Features of whole log lines, whatever their shape, and how often each occurs."""
    return flat_features(_nodes(spark, sf), "line_id").groupBy("feature").agg(F.count("*").alias("n"))


FORBIDDEN = ("worker", "target_context", "expected", "source_files")


@query("v07_forbidden_keys", f"WITH {_NODES} SELECT name, count(DISTINCT line_id) AS lines, count(*) AS n FROM n WHERE NOT in_array AND name IN {FORBIDDEN} GROUP BY name")
def v07(spark, sf):
    """Keys that must not occur at any depth: lines that have them, and how often."""
    return keys_found(_nodes(spark, sf), "line_id", FORBIDDEN).groupBy("name").agg(F.count("*").alias("lines"), F.sum("n").alias("n"))


@query("v09_usage_values", f"WITH {_NODES} SELECT name, count(*) AS n, count(*) FILTER (WHERE value::DOUBLE <> 0) AS nonzero, round(sum(value::DOUBLE), 4) AS total FROM n WHERE NOT in_array AND starts_with(name, 'numeric_') AND {_NUMBER} GROUP BY name")
def v09(spark, sf):
    """Numbers anywhere whose key has a prefix: how many there are, and how many are not 0."""
    x = numbers_of(_nodes(spark, sf), F.col("name").startswith("numeric_"))
    return x.groupBy("name").agg(F.count("*").alias("n"), F.count_if(F.col("number") != 0).alias("nonzero"), F.round(F.sum("number"), 4).alias("total"))


@query("proj11_harvested_numbers", f"WITH {_NODES} SELECT line_id, count(*) AS numbers, sum(value::DOUBLE)::BIGINT AS total, max(value::DOUBLE)::BIGINT AS most FROM n WHERE NOT in_array AND name IN ('line', 'column', 'rank_index') AND {_NUMBER} GROUP BY line_id")
def proj11(spark, sf):
    """Line and rank numbers harvested from wherever they stand in a log line."""
    x = numbers_of(_nodes(spark, sf), F.col("name").isin("line", "column", "rank_index"))
    return x.groupBy("line_id").agg(F.count("*").alias("numbers"), F.sum("number").cast("long").alias("total"), F.max("number").cast("long").alias("most"))


def _lexical(c: str) -> str:
    words = f"list_filter(regexp_extract_all(replace(lower({c}), '_', ' '), '[a-z0-9]+'), lambda w: w NOT IN ('a', 'an', 'and', 'or', 'the', 'to'))"
    forms = "[w, CASE WHEN len(w) > 3 AND w LIKE '%ies' THEN w[:-4] || 'y' END, CASE WHEN len(w) > 3 AND w LIKE '%s' THEN w[:-2] END, CASE WHEN len(w) > 5 AND w LIKE '%ing' THEN w[:-4] END, CASE WHEN w LIKE 'validat%' THEN 'validate' END, CASE WHEN w LIKE 'validat%' THEN 'validation' END]"
    return f"list_distinct(list_filter(flatten(list_transform({words}, lambda w: {forms})), lambda x: x IS NOT NULL))"


@query("x04_lexical_variants", f"WITH {T}, w AS (SELECT unnest({_lexical('prompt')}) AS term FROM t) SELECT term, count(*) AS n FROM w GROUP BY term")
def x04(spark, sf):
    return tasks(spark, sf).select(F.explode(lexical_tokens(F.col("prompt"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query("x20_hint_bonus", f"WITH {T}, w AS (SELECT task_id, {_lexical('prompt')} AS q, {_lexical('family')} AS d FROM t) SELECT task_id, coalesce(round(0.45 * len(list_intersect(d, q)) / nullif(len(d), 0), 6), 0) AS bonus FROM w")
def x20(spark, sf):
    """A bonus for prompts that name their family: 0.45 times the share of the family's words among the prompt's."""
    d, q = lexical_tokens(F.col("family")), lexical_tokens(F.col("prompt"))
    w = tasks(spark, sf).select("task_id", q.alias("q"), d.alias("d"))
    return w.select("task_id", F.coalesce(F.round(F.try_divide(F.lit(0.45) * F.size(F.array_intersect("d", "q")), F.size("d")), 6), F.lit(0.0)).alias("bonus"))


@query("x07_blake2b_features")
def x07(spark, sf):
    """Prompt words hashed to 64 signed cells by BLAKE2b: each word adds its sign times log(1 + its count)."""
    words = tasks(spark, sf).select("task_id", F.explode(tokens(F.col("prompt"))).alias("token")).groupBy("task_id", "token").agg(F.count("*").alias("n"))
    cells = words.select("task_id", blake2b_cell(F.col("token"), 64).alias("c"), "n").select("task_id", "c.bucket", (F.col("c.sign") * F.log1p("n")).alias("x"))
    return cells.groupBy("task_id", "bucket").agg(F.round(F.sum("x"), 9).alias("value"))


@query("x17_family_split")
def x17(spark, sf):
    """70, 10 and 20 percent of the families by the BLAKE2b digest of their names."""
    t = F.col("tenth")
    f = tasks(spark, sf).where(F.col("family").isNotNull()).select("family").distinct().withColumn("tenth", blake2b_tenth(F.col("family")))
    return f.select("family", F.when(t < 7, "train").when(t < 8, "validation").otherwise("test").alias("split"))


@query("x22_ast_feature_delta")
def x22(spark, sf):
    """Kinds of syntax nodes that changes to Python files add and remove; changes of which one side does not parse have none."""
    m = read(spark, sf, "mined_git_transitions").where(F.lower("file_path").endswith(".py") & F.col("before_source").isNotNull() & F.col("after_source").isNotNull())
    m = m.select("transition_id", "before_source", "after_source").dropDuplicates(["transition_id"])
    after, before = ast_features(m, "transition_id", "after_source"), ast_features(m, "transition_id", "before_source").withColumn("n", -F.col("n"))
    d = after.unionByName(before).groupBy("transition_id", "feature").agg(F.sum("n").alias("d"))
    broken = d.where(F.col("feature").isNull()).select("transition_id")
    whole = d.join(broken.hint("merge"), "transition_id", "left_anti")
    return whole.groupBy("feature").agg(F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("d"))), F.lit(0)).alias("added"), F.coalesce(-F.sum(F.when(F.col("d") < 0, F.col("d"))), F.lit(0)).alias("removed"))


@query("s06_commented_lines", f"WITH {T} SELECT task_id, name FROM t")
def s06(spark, sf):
    """Lines behind a comment each, written and read back without the comments."""
    path = scratch_path(spark, "commented")
    lines = tasks(spark, sf).select(F.explode(F.array(F.concat(F.lit("# "), "name"), F.to_json(F.struct("task_id", "name")))).alias("value"))
    lines.write.text(path)
    return read_commented(spark, path, "task_id long, name string")


@query("s10_source_tree", "WITH m AS (SELECT DISTINCT transition_id, after_source AS s FROM mined_git_transitions WHERE lower(file_path) LIKE '%.py' AND after_source IS NOT NULL), f AS (SELECT transition_id % 16 AS folder, count(*) AS n FROM m WHERE transition_id % 16 <> 7 GROUP BY 1) SELECT folder, n AS sources FROM f")
def s10(spark, sf):
    """Python sources written below folders of their own, one of them excluded, and scanned again."""
    path = scratch_path(spark, "sources")
    m = read(spark, sf, "mined_git_transitions").where(F.lower("file_path").endswith(".py") & F.col("after_source").isNotNull()).select("transition_id", "after_source").dropDuplicates(["transition_id"])
    one_line = F.regexp_replace("after_source", r"[\r\n  \u0085\f\x0b]", " ")
    folder = F.when(F.col("transition_id") % 16 == 7, "node_modules").otherwise((F.col("transition_id") % 16).cast("string"))
    m.select(one_line.alias("value"), folder.alias("folder")).write.partitionBy("folder").text(path)
    found = source_tree(spark, path, "*.txt", ("folder=node_modules",))
    at = F.regexp_extract("path", r"folder=(\d+)/", 1).cast("long")
    return found.groupBy(at.alias("folder")).agg(F.sum(F.regexp_count("source", F.lit("\n"))).cast("long").alias("sources"))


_FIELDS = {"action_kind": "structured_action.kind", "outcome_kind": "outcome.kind", "outcome_status": "outcome.status", "embedding_dim": "prompt_context.embedding_dim"}


@query("a16_e01_predicted_fields", f"WITH {TR}, x AS (SELECT id, unnest([{', '.join(f'{{f: {chr(39)}{n}{chr(39)}, e: ({c})::VARCHAR, p: ({p})::VARCHAR}}' for n, c, p in ((n, c, 'prompt_jepa_target.embedding_dim' if n == 'embedding_dim' else f'prompt_jepa_target.summary.{n}') for n, c in _FIELDS.items()))}]) AS r FROM tr), y AS (SELECT id, r.f AS field, r.e IS NOT DISTINCT FROM r.p AS ok FROM x) SELECT field, count(*) AS total, count(*) FILTER (WHERE ok) AS correct, round(count(*) FILTER (WHERE ok) / count(*), 6) AS accuracy FROM y GROUP BY field UNION ALL SELECT '(row)', count(*), count(*) FILTER (WHERE w), round(count(*) FILTER (WHERE w) / count(*), 6) FROM (SELECT id, bool_and(ok) AS w FROM y GROUP BY id)")
def a16_e01(spark, sf):
    """Any predictor, given as a function on frames, evaluated field by field and row by row; here it reads the summary."""

    def summary(rows):
        s = F.col("prompt_jepa_target.summary")
        return rows.select("id", *[s[n].alias(n) for n in ("action_kind", "outcome_kind", "outcome_status")], F.col("prompt_jepa_target.embedding_dim").alias("embedding_dim"))

    return evaluate_predictions(transitions(spark, sf), "id", {n: F.col(c) for n, c in _FIELDS.items()}, summary)[0]


@query("e03_strategies", f"WITH {C} SELECT 'hints' AS strategy, candidate_id, row_number() OVER (PARTITION BY task, ph, plan ORDER BY CASE WHEN isnan(failure_hint_score) THEN NULL ELSE failure_hint_score END DESC NULLS LAST, rk, candidate_id) AS place FROM c QUALIFY place <= 2 UNION ALL SELECT 'small', candidate_id, row_number() OVER (PARTITION BY task, ph, plan ORDER BY diff_added_lines + diff_removed_lines, rk, candidate_id) AS place FROM c QUALIFY place <= 2")
def e03(spark, sf):
    """Ranking strategies passed in by name, each an order of columns."""
    score = F.when(~F.isnan("failure_hint_score"), F.col("failure_hint_score"))
    given = {"hints": [score.desc_nulls_last(), *sort_order()], "small": [(F.col("diff_added_lines") + F.col("diff_removed_lines")).asc_nulls_last(), *sort_order()]}
    return ranked_by(outcomes(spark, sf, "failure_hint_score", "diff_added_lines", "diff_removed_lines"), PLAN, given, 2).select("strategy", "candidate_id", F.col("place").cast("long").alias("place"))
