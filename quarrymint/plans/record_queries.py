"""Queries of record projections, validators, model documents, training pairs and retrieval modes."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from quarrymint.functions.hashing import stable_fraction
from quarrymint.operators.duplicates import near_duplicates
from quarrymint.operators.ranking import numbered
from quarrymint.operators.retrieval import knn
from quarrymint.operators.rollup import ratio, sigmoid
from quarrymint.operators.validation import read_model, violations
from quarrymint.plans.base import PLAN, TR, C, O, T, outcomes, register, sort_order, tasks, transitions
from quarrymint.plans.model_queries import _predicted_hits
from quarrymint.plans.order_queries import _vectors
from quarrymint.session import cut, read, scratch_path

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = partial(register, QUERIES, ORACLE)

_HINT = "list_filter(failure_hints, lambda h: h.exception_type IS NOT NULL)[1]"


@query("proj07_label_records", f"WITH {T} SELECT task_id, coalesce(preferred.action, 'none') AS expected_action, CASE WHEN prompt IS NULL OR trim(prompt) = '' THEN 'yes' ELSE 'no' END AS requires_clarification, regexp_extract(test, '([^/]+?)(::.*)?$', 1) AS primary_artifact, coalesce(list_sort(map_keys(preferred.params))[1], 'none') AS primary_field, coalesce(lower(trim(family)), 'none') AS family FROM t")
def proj07(spark, sf):
    """Tasks as label records with the scalar targets that are derived from them."""
    first = F.get(F.array_sort(F.map_keys("preferred.params")), F.lit(0))
    blank = F.col("prompt").isNull() | (F.trim("prompt") == "")
    return tasks(spark, sf).select(
        "task_id", F.coalesce("preferred.action", F.lit("none")).alias("expected_action"), F.when(blank, "yes").otherwise("no").alias("requires_clarification"),
        F.regexp_extract("test", r"([^/]+?)(::.*)?$", 1).alias("primary_artifact"), F.coalesce(first, F.lit("none")).alias("primary_field"), F.coalesce(F.lower(F.trim("family")), F.lit("none")).alias("family"),
    )


@query("proj09_choice_candidates", f"WITH {C}, {O} SELECT candidate_id, pos AS place, action, file_path || ':' || start_line || '-' || end_line AS source_context, coalesce(symbol, '(module)') AS symbol, CASE WHEN isnan(model_score) THEN NULL ELSE model_score END AS model_score, CASE WHEN isnan(failure_hint_score) THEN NULL ELSE failure_hint_score END AS hint_score, CASE WHEN passed IS NULL THEN 'unvalidated' WHEN passed THEN 'passed' ELSE 'failed' END AS validation, diff_added_lines AS added, diff_removed_lines AS removed FROM o")
def proj09(spark, sf):
    """Candidates as the choices of their plan: place, context, scores, validation and change."""
    df = outcomes(spark, sf, "action", "file_path", "start_line", "end_line", "symbol", "model_score", "failure_hint_score", "diff_added_lines", "diff_removed_lines")
    score = lambda c: F.when(~F.isnan(c), F.col(c))
    context = F.concat("file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    validation = F.when(F.col("passed").isNull(), "unvalidated").when(F.col("passed"), "passed").otherwise("failed")
    return numbered(df, PLAN, sort_order(), "place").select("candidate_id", "place", "action", context.alias("source_context"), F.coalesce("symbol", F.lit("(module)")).alias("symbol"), score("model_score").alias("model_score"), score("failure_hint_score").alias("hint_score"), validation.alias("validation"), F.col("diff_added_lines").alias("added"), F.col("diff_removed_lines").alias("removed"))


@query("proj15_compact_summaries", f"WITH {C} SELECT candidate_id, action || ' ' || coalesce(symbol, file_path) AS summary, rank_index AS rank, coalesce(passed, false) AS passed, coalesce(len(failure_hints), 0) AS hints, substr(reason, 1, 40) AS reason FROM c")
def proj15(spark, sf):
    n = F.when(F.col("failure_hints").isNotNull(), F.size("failure_hints")).otherwise(0).cast("long")
    return outcomes(spark, sf, "action", "symbol", "file_path", "failure_hints", "reason").select("candidate_id", F.concat("action", F.lit(" "), F.coalesce("symbol", "file_path")).alias("summary"), F.col("rank_index").alias("rank"), F.coalesce("passed", F.lit(False)).alias("passed"), n.alias("hints"), F.substring("reason", 1, 40).alias("reason"))


@query("proj19_attempt_rows", f"WITH {C} SELECT candidate_id, task, CASE WHEN passed THEN 'passed' WHEN passed IS NULL THEN 'not_run' ELSE 'failed' END AS status, CASE WHEN passed IS NOT TRUE THEN {_HINT}.exception_type END AS failure_kind, CASE WHEN passed IS NOT TRUE THEN {_HINT}.nodeid END AS failing_test, CASE WHEN passed IS NOT TRUE THEN len({_HINT}.assertions) END AS assertions FROM c")
def proj19(spark, sf):
    """Attempts with what was observed of their failure: kind, test and number of assertions of the first hint that has a kind."""
    h = F.get(F.filter("failure_hints", lambda x: x["exception_type"].isNotNull()), F.lit(0))
    df = outcomes(spark, sf, "failure_hints").withColumn("h", F.when(~F.coalesce("passed", F.lit(False)), h))
    status = F.when(F.col("passed"), "passed").when(F.col("passed").isNull(), "not_run").otherwise("failed")
    n = F.when(F.col("h.assertions").isNotNull(), F.size("h.assertions")).cast("long")
    return df.select("candidate_id", "task", status.alias("status"), F.col("h.exception_type").alias("failure_kind"), F.col("h.nodeid").alias("failing_test"), n.alias("assertions"))


@query("u02_bench_rows", f"""WITH {C}, {TR}, m AS (SELECT * FROM mined_git_transitions QUALIFY row_number() OVER (PARTITION BY transition_id ORDER BY ingested_at) = 1)
SELECT 'candidate' AS row_kind, candidate_id::VARCHAR AS id, task AS group_id, action, CASE WHEN passed IS NULL THEN 'unknown' WHEN passed THEN 'passed' ELSE 'failed' END AS label, (language IS NOT NULL) AS complete FROM c
UNION ALL SELECT 'prompt_repo', id, structured_action.task_type, structured_action.kind, CASE WHEN outcome.passed IS NULL THEN 'unknown' WHEN outcome.passed THEN 'passed' ELSE 'failed' END, repo_before IS NOT NULL AND repo_after IS NOT NULL FROM tr
UNION ALL SELECT 'git', transition_id::VARCHAR, repo, kind, 'unknown', before_source IS NOT NULL AND after_source IS NOT NULL FROM m""")
def u02_rows(spark, sf):
    """Candidates, prompt transitions and mined changes as rows of one shape."""
    label = lambda c: F.when(F.col(c).isNull(), "unknown").when(F.col(c), "passed").otherwise("failed")
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    names = ["row_kind", "id", "group_id", "action", "label", "complete"]
    c = outcomes(spark, sf, "action", "language").select(F.lit("candidate"), F.col("candidate_id").cast("string"), "task", "action", label("passed"), F.col("language").isNotNull()).toDF(*names)
    t = transitions(spark, sf).select(F.lit("prompt_repo"), "id", "structured_action.task_type", "structured_action.kind", label("outcome.passed"), both("repo_before", "repo_after")).toDF(*names)
    m = read(spark, sf, "mined_git_transitions").select("transition_id", "repo", "kind", both("before_source", "after_source").alias("complete")).dropDuplicates(["transition_id"])
    g = m.select(F.lit("git"), F.col("transition_id").cast("string"), "repo", "kind", F.lit("unknown"), "complete").toDF(*names)
    return c.unionByName(t).unionByName(g)


@query("u07_summaries_of_sets", f"WITH {C} " + " UNION ALL ".join(f"SELECT '{s}' AS task_set, count(*) AS candidates, count(DISTINCT task) AS tasks, count(*) FILTER (WHERE passed) AS passing FROM c WHERE lower(trim(split)) = '{s}'" for s in ("train", "validation", "test")))
def u07(spark, sf):
    """One summary for each set of tasks, put one after another."""
    df = outcomes(spark, sf, "split").withColumn("s", F.lower(F.trim("split")))
    out = None
    for s in ("train", "validation", "test"):
        per = df.where(F.col("s") == s).groupBy("task").agg(F.count("*").alias("n"), F.count_if("passed").alias("p"))
        one = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("candidates"), F.count("*").alias("tasks"), F.coalesce(F.sum("p"), F.lit(0)).alias("passing")).select(F.lit(s).alias("task_set"), "candidates", "tasks", "passing")
        out = one if out is None else out.unionByName(one)
    return out


@query("w11_rank_positions", f"WITH {C} SELECT candidate_id, list_position(overlapping_candidate_ranks, rank_index) AS place FROM c WHERE overlapping_candidate_ranks IS NOT NULL AND rank_index IS NOT NULL")
def w11(spark, sf):
    """Where a candidate's own rank stands in its list of overlapping ranks, from 1; null where it does not."""
    df = outcomes(spark, sf, "overlapping_candidate_ranks").where("overlapping_candidate_ranks is not null and rank_index is not null")
    return df.select("candidate_id", F.nullif(F.array_position("overlapping_candidate_ranks", F.col("rank_index")), F.lit(0)).cast("int").alias("place"))


@query("a05_class_means", f"WITH {C} SELECT passed, count(*) AS n, round(avg(1 / (1 + exp(-model_score))), 6) AS mean_probability FROM c WHERE model_score IS NOT NULL AND NOT isnan(model_score) AND passed IS NOT NULL GROUP BY passed")
def a05_means(spark, sf):
    """Mean probability of candidates that passed and of those that did not."""
    df = outcomes(spark, sf, "model_score").where(F.col("model_score").isNotNull() & ~F.isnan("model_score") & F.col("passed").isNotNull())
    return df.groupBy("passed").agg(F.count("*").alias("n"), F.round(F.avg(sigmoid(F.col("model_score"))), 6).alias("mean_probability"))


_V04 = {"phase": "ph IN ('ranked', 'baseline', 'repair')", "span": "start_line >= 1 AND end_line >= start_line", "counts": "diff_added_lines >= 0 AND diff_removed_lines >= 0", "first_passing": "first_passing_index IS NULL OR first_passing_index >= 1", "passing": "passing_candidates >= 0", "score": "model_score IS NULL OR (NOT isnan(model_score) AND model_score BETWEEN 0 AND 1)", "preferred_passes": "NOT preferred OR coalesce(passed, false)"}
_V08 = {"version": "schema_version = 'prompt-repo-transition-v1'", "before": "repo_before.state_checksum IS NOT NULL", "after": "outcome.status = 'blocked' OR repo_after.state_checksum IS NOT NULL", "status": "validation.status IS NOT NULL", "commands": "len(validation.commands) >= 1"}
_S15 = {"name": "trim(name) <> ''", "prompt": "trim(prompt) <> ''", "test": "test LIKE '%.py%'", "steps": "max_steps IS NULL OR max_steps >= 1", "split": "lower(trim(split)) IN ('train', 'validation', 'val', 'dev', 'test')", "family": "trim(family) <> ''"}


def _rules_sql(rules: dict) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (WHERE NOT coalesce({e}, false)) AS rows_ FROM x" for n, e in rules.items())


def _broken(df, key: str, rules: dict):
    counted = violations(df, key, {n: F.expr(e.replace("len(", "size(")) for n, e in rules.items()}).groupBy("rule").agg(F.count("*").alias("rows_"))
    every = df.sparkSession.createDataFrame([(n,) for n in rules], "rule string")
    return every.join(F.broadcast(counted), "rule", "left").select("rule", F.coalesce("rows_", F.lit(0)).alias("rows_"))  # one row a rule


@query("v04_outcome_rules", f"WITH {C}, x AS (SELECT * FROM c) {_rules_sql(_V04)}")
def v04(spark, sf):
    """Rules of candidate outcomes, and how many rows break each."""
    return _broken(outcomes(spark, sf, "start_line", "end_line", "diff_added_lines", "diff_removed_lines", "first_passing_index", "passing_candidates", "model_score", "preferred"), "candidate_id", _V04)


@query("v08_transition_rules", f"WITH {TR}, x AS (SELECT * FROM tr) {_rules_sql(_V08)}")
def v08(spark, sf):
    return _broken(transitions(spark, sf), "id", _V08)


@query("s15_manifest_rules", f"WITH {T}, x AS (SELECT * FROM t) {_rules_sql(_S15)}")
def s15(spark, sf):
    return _broken(tasks(spark, sf), "task_id", _S15)


@query("v03_conflicting_ids", f"WITH k AS (SELECT id, count(*) AS n, count(DISTINCT prompt_context.embedding_checksum) AS vectors FROM prompt_repo_transitions GROUP BY id) SELECT count(*) AS ids, count(*) FILTER (WHERE n > 1) AS delivered_again, count(*) FILTER (WHERE vectors > 1) AS conflicting FROM k")
def v03(spark, sf):
    """Ids that occur more than once, and those among them whose vectors differ."""
    df = read(spark, sf, "prompt_repo_transitions").select("id", F.col("prompt_context.embedding_checksum").alias("v"))
    k = df.groupBy("id").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    return k.agg(F.count("*").alias("ids"), F.count_if(F.col("n") > 1).alias("delivered_again"), F.count_if(F.col("lo") != F.col("hi")).alias("conflicting"))


@query("s07_model_document", "SELECT vec_id AS id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 4) AS squares FROM embeddings")
def s07(spark, sf):
    """An index written as JSON documents of 64 rows and read back behind checks of format, version and dimension."""
    path = scratch_path(spark, "model")
    e = read(spark, sf, "embeddings").select(F.struct(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")).alias("r"))
    docs = e.groupBy(F.floor(F.col("r.id") / 64).alias("part")).agg(F.collect_list("r").alias("rows"))  # 64 at most
    docs.select(F.lit("vector-index").alias("format"), F.lit(1).alias("version"), F.lit(64).alias("dim"), "rows").write.json(path)
    rows = read_model(spark, path, "id: bigint, v: array<double>", "vector-index", 1, 64)
    return rows.select("id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 4).alias("squares"))


@query("s12_nested_export", "WITH c AS (SELECT * FROM candidate_outcomes QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY ingested_at) = 1), h AS (SELECT candidate_id, unnest(failure_hints) AS h FROM c), f AS (SELECT candidate_id, unnest(h.source_files) AS f FROM h WHERE h IS NOT NULL) SELECT f AS source_file, count(*) AS mentions, count(DISTINCT candidate_id) AS candidates FROM f WHERE f IS NOT NULL GROUP BY f")
def s12(spark, sf):
    """Candidates exported as nested JSON, scanned again, two levels of arrays opened."""
    path = scratch_path(spark, "export")
    df = outcomes(spark, sf, "failure_hints").select("candidate_id", F.transform("failure_hints", lambda h: F.struct(h["source_files"].alias("files"))).alias("hints"))
    df.write.json(path)
    back = spark.read.schema("candidate_id long, hints array<struct<files: array<string>>>").json(path)
    files = back.select("candidate_id", F.explode(F.flatten(F.filter(F.transform("hints", lambda h: h["files"]), lambda x: x.isNotNull()))).alias("source_file")).where(F.col("source_file").isNotNull())
    return files.groupBy("source_file", "candidate_id").agg(F.count("*").alias("n")).groupBy("source_file").agg(F.sum("n").alias("mentions"), F.count("*").alias("candidates"))


@query("s16_training_pairs", f"WITH {C}, {O}, r AS (SELECT *, ('0x' || substr(sha256('holdout:' || coalesce(task_family, '-')), 1, 16))::UBIGINT::DOUBLE / 18446744073709551615.0 AS f FROM o WHERE ph = 'ranked'), k AS (SELECT * FROM r WHERE f >= 0.2), g AS (SELECT task, plan, min(pos) FILTER (WHERE passed) AS first FROM k GROUP BY 1, 2) SELECT k.candidate_id AS negative, g.first AS positive_place, k.pos AS negative_place FROM k JOIN g ON g.task = k.task AND g.plan IS NOT DISTINCT FROM k.plan WHERE k.passed IS NOT TRUE AND k.pos < g.first")
def s16(spark, sf):
    """Pairs for a ranker from ranked plans outside the holdout families: the first passing candidate, and each failing one
    that stands before it. As many pairs as candidates at most."""
    held = stable_fraction(F.concat(F.lit("holdout:"), F.coalesce("task_family", F.lit("-")))) < 0.2
    df = outcomes(spark, sf, "task_family").where(F.col("ph") == "ranked").withColumn("held", held)
    rows = cut(numbered(df, PLAN, sort_order(), "pos").where(~F.col("held")).select("candidate_id", "task", "plan", "passed", "pos"), "ranker-rows")
    first = rows.groupBy("task", F.col("plan").alias("plan_")).agg(F.min(F.when(F.col("passed"), F.col("pos"))).alias("first")).withColumnRenamed("task", "task_")
    pairs = rows.where(~F.coalesce("passed", F.lit(False))).join(first, (F.col("task") == F.col("task_")) & F.col("plan").eqNullSafe(F.col("plan_")))
    return pairs.where(F.col("pos") < F.col("first")).select(F.col("candidate_id").alias("negative"), F.col("first").alias("positive_place"), F.col("pos").alias("negative_place"))


@query("r09_retrieval_modes")
def r09_modes(spark, sf):
    """Retrieval by a vector itself beside retrieval by its predicted target, evaluated on the same queries and labels."""
    e = read(spark, sf, "embeddings")
    p = _vectors(spark, sf)
    near = knn(p, p.where(F.col("id") % 20 == 0), 3)
    j = near.join(e.select(F.col("vec_id").alias("query"), F.col("label").alias("expected")), "query").join(e.select(F.col("vec_id").alias("id"), "label"), "id").where(F.col("expected").isNotNull())
    hit = F.coalesce(F.col("label") == F.col("expected"), F.lit(False))
    plain = j.groupBy("query").agg(F.bool_or(hit & (F.col("rank") == 1)).alias("hit_1"), F.bool_or(hit).alias("hit_3")).withColumn("mode", F.lit("context"))
    target = _predicted_hits(spark, sf).select("query", "hit_1", "hit_3").withColumn("mode", F.lit("predicted_target"))
    one, three, n = F.count_if("hit_1"), F.count_if("hit_3"), F.count("*")
    return plain.unionByName(target).groupBy("mode").agg(n.alias("queries"), one.alias("top_1"), three.alias("top_3"), ratio(one, n).alias("top_1_accuracy"), ratio(three, n).alias("top_3_accuracy"))


@query("j08_d06_near_duplicates")
def j08(spark, sf):
    """Prompts that almost occur on another side of the split: pairs of classes of equal prompts."""
    split = F.lower(F.trim("split"))
    side = F.when(split.isin("validation", "val", "dev"), "validation").when(split.isin("train", "test"), split)
    return near_duplicates(tasks(spark, sf), "task_id", "prompt", side)
