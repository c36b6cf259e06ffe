"""Queries of the aggregation operators."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymint.operators.ranking import first_label, first_where
from quarrymint.operators.rollup import by_dimensions, calibration, centroids, confusion, histogram, majority, rank_metrics, ratio, ratio0, sigmoid
from quarrymint.plans.base import ORDER, PLAN, C, O, T, TR, group_text, outcomes, register, tasks, transitions
from quarrymint.session import cut, read, skew_join

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = partial(register, QUERIES, ORACLE)

_NB = "NOT regexp_full_match({0}, '\\s*')"


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each plan: labels in rank order, counts, whether the first candidate passed."""
    df = outcomes(spark, sf_dir, "task_family", "source_type", "split", "preferred", "action")
    ok = F.coalesce("passed", F.lit(False))
    return df.groupBy(*PLAN).agg(
        first_label("task_family", ORDER()).alias("family"),
        first_label("source_type", ORDER()).alias("source_type"),
        first_label("split", ORDER()).alias("split"),
        F.count("*").alias("n"),
        F.count_if(ok).alias("passing"),
        F.count_if(ok & F.coalesce("preferred", F.lit(False))).alias("preferred"),
        F.coalesce(F.min_by(ok, ORDER()), F.lit(False)).alias("first_passed"),
        first_where(F.col("action"), ok, ORDER()).alias("winning_action"),
    )


_PLANS = f"""plans AS (SELECT task, ph, plan, arg_min(task_family, (rk, candidate_id)) FILTER (WHERE {_NB.format('task_family')}) AS family,
  arg_min(source_type, (rk, candidate_id)) FILTER (WHERE {_NB.format('source_type')}) AS source_type,
  arg_min(split, (rk, candidate_id)) FILTER (WHERE {_NB.format('split')}) AS split, count(*) AS n,
  count(*) FILTER (WHERE passed) AS passing, count(*) FILTER (WHERE passed AND preferred) AS preferred,
  arg_min(coalesce(passed, false), (rk, candidate_id)) AS first_passed, arg_min(action, (rk, candidate_id)) FILTER (WHERE passed) AS winning_action FROM c GROUP BY task, ph, plan)"""


def _union(table: str, dims: dict[str, str], aggregates: str) -> str:
    return " UNION ALL ".join(f"SELECT '{d}' AS dimension, coalesce({e}::VARCHAR, '(none)') AS value, {aggregates} FROM {table} GROUP BY 2" for d, e in dims.items())


_A01 = "count(*) AS plans, sum(n)::BIGINT AS rows_, sum(passing)::BIGINT AS passing, sum(preferred)::BIGINT AS preferred, count(*) FILTER (WHERE passing > 0) AS solved, round(count(*) FILTER (WHERE first_passed) / count(*), 6) AS pass_at_1, round(avg(n), 6) AS avg_candidates"


@query("a01_outcome_summary", f"WITH {C}, {_PLANS} " + _union("plans", {"all": "'*'", "family": "family", "source_type": "source_type", "split": "split"}, _A01))
def a01(spark, sf_dir):
    return by_dimensions(
        plans(spark, sf_dir),
        {"all": None, "family": F.col("family"), "source_type": F.col("source_type"), "split": F.col("split")},
        F.count("*").alias("plans"),
        F.sum("n").alias("rows_"),
        F.sum("passing").alias("passing"),
        F.sum("preferred").alias("preferred"),
        F.count_if(F.col("passing") > 0).alias("solved"),
        ratio(F.count_if("first_passed"), F.count("*")).alias("pass_at_1"),
        F.round(F.avg("n"), 6).alias("avg_candidates"),
    )


@query("a01_actions", f"WITH {C} SELECT action, count(*) AS rows_, count(*) FILTER (WHERE passed) AS passing FROM c GROUP BY action")
def a01_actions(spark, sf_dir):
    return outcomes(spark, sf_dir, "action").groupBy("action").agg(F.count("*").alias("rows_"), F.count_if("passed").alias("passing"))


_MODE = "CASE WHEN first_passed THEN 'pass_at_1' WHEN passing > 0 THEN 'bad_ranking' WHEN n < 3 THEN 'missing_action' ELSE 'search_budget_or_bad_ranking' END"


def _mode():
    return F.when(F.col("first_passed"), "pass_at_1").when(F.col("passing") > 0, "bad_ranking").when(F.col("n") < 3, "missing_action").otherwise("search_budget_or_bad_ranking")


@query("a02_eval_rollup", f"WITH {C}, {_PLANS}, p AS (SELECT *, {_MODE} AS mode FROM plans) " + _union("p", {"action": "winning_action", "family": "family", "source_type": "source_type", "mode": "mode"}, "count(*) AS plans, count(*) FILTER (WHERE passing > 0) AS solved, round(avg(n), 6) AS avg_candidates"))
def a02(spark, sf_dir):
    return by_dimensions(plans(spark, sf_dir).withColumn("mode", _mode()), {"action": F.col("winning_action"), "family": F.col("family"), "source_type": F.col("source_type"), "mode": F.col("mode")}, F.count("*").alias("plans"), F.count_if(F.col("passing") > 0).alias("solved"), F.round(F.avg("n"), 6).alias("avg_candidates"))


@query("a03_plan_summary", f"WITH {C}, {_PLANS} SELECT * FROM plans")
def a03(spark, sf_dir):
    return plans(spark, sf_dir)


_A04 = f"""g AS (SELECT task, ph, plan, count(*) AS n, count(*) FILTER (WHERE passed) AS passing, min(pos) FILTER (WHERE passed) AS first_pos,
  arg_min(action, (CASE WHEN passed AND preferred THEN 0 WHEN passed AND is_first_pass THEN 1 ELSE 2 END, pos)) FILTER (WHERE passed) AS action,
  arg_min(pos, (CASE WHEN passed AND preferred THEN 0 WHEN passed AND is_first_pass THEN 1 ELSE 2 END, pos)) FILTER (WHERE passed) AS positive_pos,
  arg_min(task_family, pos) FILTER (WHERE {_NB.format('task_family')}) AS family FROM o GROUP BY task, ph, plan)"""
_A04_AGG = "count(*) AS plans, sum(n)::BIGINT AS rows_, sum(passing)::BIGINT AS passing, sum(n - passing)::BIGINT AS failing, count(*) FILTER (WHERE first_pos = 1) AS pass_at_1, count(*) FILTER (WHERE positive_pos = 1) AS positive_at_1, round(avg(first_pos), 6) AS avg_first_pass, round(avg(positive_pos), 6) AS avg_positive_rank, sum(n - passing)::BIGINT AS pairs"


def placed(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Candidates with their 1-based place in the plan (``pos``)."""
    from quarrymint.operators.ranking import numbered
    from quarrymint.plans.base import sort_order

    return numbered(outcomes(spark, sf_dir, *columns), PLAN, sort_order(), "pos")


@query("a04_ranker_metrics", f"WITH {C}, {O}, {_A04}, s AS (SELECT * FROM g WHERE passing > 0) " + _union("s", {"action": "action", "family": "family"}, _A04_AGG))
def a04(spark, sf_dir):
    ok = F.coalesce("passed", F.lit(False))
    tier = F.struct(F.when(F.coalesce("preferred", F.lit(False)), 0).when(F.coalesce("is_first_pass", F.lit(False)), 1).otherwise(2), F.col("pos"))
    g = placed(spark, sf_dir, "action", "task_family", "preferred", "is_first_pass").groupBy(*PLAN).agg(
        F.count("*").alias("n"), F.count_if(ok).alias("passing"), F.min(F.when(ok, F.col("pos"))).alias("first_pos"), first_where(F.col("action"), ok, tier).alias("action"), first_where(F.col("pos"), ok, tier).alias("positive_pos"), first_label("task_family", F.col("pos")).alias("family")
    )
    return by_dimensions(
        g.where(F.col("passing") > 0), {"action": F.col("action"), "family": F.col("family")},
        F.count("*").alias("plans"), F.sum("n").alias("rows_"), F.sum("passing").alias("passing"), F.sum(F.col("n") - F.col("passing")).alias("failing"), F.count_if(F.col("first_pos") == 1).alias("pass_at_1"),
        F.count_if(F.col("positive_pos") == 1).alias("positive_at_1"), F.round(F.avg("first_pos"), 6).alias("avg_first_pass"), F.round(F.avg("positive_pos"), 6).alias("avg_positive_rank"), F.sum(F.col("n") - F.col("passing")).alias("pairs"),
    )


@query("a05_calibration", f"""WITH {C}, p AS (SELECT 1 / (1 + exp(-model_score)) AS p, passed::INT AS y FROM c WHERE model_score IS NOT NULL AND NOT isnan(model_score) AND passed IS NOT NULL),
b AS (SELECT least(floor(p * 5), 4)::BIGINT AS bucket, count(*) AS n, avg(p) AS ap, avg(y) AS ay, sum((p - y) * (p - y)) AS sq FROM p GROUP BY 1), s AS (SELECT sum(n) AS total FROM b)
SELECT r.range::BIGINT AS bucket, coalesce(n, 0)::BIGINT AS n, round(ap, 6) AS mean_probability, round(ay, 6) AS rate, coalesce(round(n * abs(ay - ap) / total, 6), 0) AS ece_part, coalesce(round(sq / total, 6), 0) AS brier_part FROM range(5) r LEFT JOIN b ON b.bucket = r.range CROSS JOIN s""")
def a05(spark, sf_dir):
    return calibration(outcomes(spark, sf_dir, "model_score"), sigmoid(F.col("model_score")), F.col("passed"))


@query("a07_agreement", f"""WITH {C}, g AS (SELECT task, ph, plan, arg_min(candidate_id, (rk, candidate_id)) AS production, arg_min(coalesce(passed, false), (rk, candidate_id)) AS production_passed,
 arg_min(candidate_id, (-coalesce(CASE WHEN isnan(ranker_score) THEN NULL ELSE ranker_score END, -1e300), rk, candidate_id)) AS scorer, arg_min(coalesce(passed, false), (-coalesce(CASE WHEN isnan(ranker_score) THEN NULL ELSE ranker_score END, -1e300), rk, candidate_id)) AS scorer_passed FROM c GROUP BY ALL)
SELECT count(*) AS plans, count(*) FILTER (WHERE production = scorer) AS agreeing, round(count(*) FILTER (WHERE production = scorer) / count(*), 6) AS agreement_rate, count(*) FILTER (WHERE scorer_passed AND NOT production_passed) AS improved, count(*) FILTER (WHERE production_passed AND NOT scorer_passed) AS regressed, count(*) FILTER (WHERE production_passed = scorer_passed) AS same, round(avg(production_passed::INT), 6) AS production_pass_at_1, round(avg(scorer_passed::INT), 6) AS scorer_pass_at_1 FROM g""".replace("GROUP BY ALL", "GROUP BY task, ph, plan"))
def a07(spark, sf_dir):
    ok = F.coalesce("passed", F.lit(False))
    score = F.struct((-F.coalesce(F.when(~F.isnan("ranker_score"), F.col("ranker_score")), F.lit(-1e300))).alias("s"), ORDER().alias("o"))
    g = outcomes(spark, sf_dir, "ranker_score").groupBy(*PLAN).agg(F.min_by("candidate_id", ORDER()).alias("production"), F.min_by(ok, ORDER()).alias("pp"), F.min_by("candidate_id", score).alias("scorer"), F.min_by(ok, score).alias("sp"))
    n = F.count("*")
    same = F.col("production") == F.col("scorer")
    return g.agg(n.alias("plans"), F.count_if(same).alias("agreeing"), ratio(F.count_if(same), n).alias("agreement_rate"), F.count_if(F.col("sp") & ~F.col("pp")).alias("improved"), F.count_if(F.col("pp") & ~F.col("sp")).alias("regressed"), F.count_if(F.col("pp") == F.col("sp")).alias("same"), F.round(F.avg(F.col("pp").cast("int")), 6).alias("production_pass_at_1"), F.round(F.avg(F.col("sp").cast("int")), 6).alias("scorer_pass_at_1"))


_DIMS = {"task_family": "task_family", "source_type": "source_type", "action": "action", "node_kind": "node_kind", "language": "language", "split": "split", "phase": "ph"}


@query("a09_residual_counters", f"WITH {C} " + _union("(SELECT * FROM c WHERE passed IS NOT TRUE)", _DIMS, "count(*) AS n"))
def a09(spark, sf_dir):
    df = outcomes(spark, sf_dir, "task_family", "source_type", "action", "node_kind", "language", "split").where(~F.coalesce("passed", F.lit(False)))
    return by_dimensions(df, {d: F.col(c) for d, c in _DIMS.items()}, F.count("*").alias("n"))


@query("a10_merged_counters", f"WITH {C}, s AS (SELECT language, action, count(*) AS n FROM c GROUP BY 1, 2) SELECT action AS value, sum(n)::BIGINT AS n, count(*) AS suites FROM s GROUP BY 1")
def a10(spark, sf_dir):
    """Counters kept for each suite (here: language), merged afterwards."""
    per = outcomes(spark, sf_dir, "language", "action").groupBy("language", "action").agg(F.count("*").alias("n"))
    return per.groupBy(F.col("action").alias("value")).agg(F.sum("n").alias("n"), F.count("*").alias("suites"))


#: Histograms of the corpus of tasks: field, SQL and column.
_PROFILE = {
    "family": ("family", lambda: F.col("family")),
    "source_type": ("source_type", lambda: F.col("source_type")),
    "split": ("split", lambda: F.col("split")),
    "repo": ("repo", lambda: F.col("repo")),
    "test": ("test", lambda: F.col("test")),
    "max_steps": ("max_steps::VARCHAR", lambda: F.col("max_steps")),
    "action": ("preferred.action", lambda: F.col("preferred.action")),
    "has_preferred": ("(preferred IS NOT NULL)::VARCHAR", lambda: F.col("preferred").isNotNull()),
    "name_words": ("len(string_split(name, '_'))::VARCHAR", lambda: F.size(F.split("name", "_"))),
    "name_first": ("string_split(name, '_')[1]", lambda: F.split("name", "_")[0]),
    "has_prompt": ("(prompt IS NOT NULL)::VARCHAR", lambda: F.col("prompt").isNotNull()),
    "created": ("strftime(created_at, '%Y-%m')", lambda: F.date_format("created_at", "yyyy-MM")),
    "params": ("coalesce(len(map_keys(preferred.params)), 0)::VARCHAR", lambda: F.coalesce(F.size(F.map_keys("preferred.params")), F.lit(0))),
}


@query("a11_corpus_profile", f"WITH {T} " + " UNION ALL ".join(f"SELECT '{f}' AS field, {e} AS value, count(*) AS n FROM t GROUP BY 2" for f, (e, _) in _PROFILE.items()) + " UNION ALL SELECT 'param', k, count(*) FROM (SELECT unnest(map_keys(preferred.params)) AS k FROM t) GROUP BY 2")
def a11(spark, sf_dir):
    return histogram(tasks(spark, sf_dir), {f: c() for f, (_, c) in _PROFILE.items()} | {"param": F.map_keys("preferred.params")})


@query("a11_key_sets", f"WITH {C} SELECT coalesce(array_to_string(list_sort(map_keys(params)), ','), '(none)') AS keys, count(*) AS n FROM c GROUP BY 1")
def a11_keys(spark, sf_dir):
    """Which sets of parameters occur, and how often."""
    keys = F.coalesce(F.array_join(F.array_sort(F.map_keys("params")), ","), F.lit("(none)"))
    return outcomes(spark, sf_dir, "params").groupBy(keys.alias("keys")).agg(F.count("*").alias("n"))


@query("a11_field_presence", f"WITH {T} " + " UNION ALL ".join(f"SELECT '{f}' AS field, count({f}) AS present, count(*) - count({f}) AS missing FROM t" for f in ("name", "family", "prompt", "repo", "source_type", "split", "preferred", "max_steps")))
def a11_presence(spark, sf_dir):
    df = tasks(spark, sf_dir)
    fields = ("name", "family", "prompt", "repo", "source_type", "split", "preferred", "max_steps")
    one = df.agg(F.count("*").alias("all_"), *[F.count(f).alias(f) for f in fields])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("present"), (F.col("all_") - F.col(f)).alias("missing")) for f in fields])).alias("x")).select("x.*")


#: Histograms of transitions: field, SQL and column; of the last four the elements are counted.
_HISTOGRAMS = {
    "schema_version": "schema_version",
    "record_kind": "source_outcome.record_kind",
    "action": "structured_action.kind",
    "repo_mode": "structured_action.repo_mode",
    "task_type": "structured_action.task_type",
    "outcome_kind": "outcome.kind",
    "status": "outcome.status",
    "failure_kind": "outcome.failure_kind",
    "validation": "validation.status",
}
_LISTS = {"feature": "structured_action.features", "target_file": "structured_action.target_files", "command": "validation.commands"}


@query("a12_transition_histograms", f"WITH {TR} " + " UNION ALL ".join(f"SELECT '{f}' AS field, {e} AS value, count(*) AS n FROM tr GROUP BY 2" for f, e in _HISTOGRAMS.items()) + " UNION ALL SELECT 'passed', outcome.passed::VARCHAR, count(*) FROM tr GROUP BY 2 " + "".join(f" UNION ALL SELECT '{f}', x, count(*) FROM (SELECT unnest({e}) AS x FROM tr) GROUP BY 2" for f, e in _LISTS.items()))
def a12(spark, sf_dir):
    fields = {f: F.col(e) for f, e in (_HISTOGRAMS | _LISTS).items()} | {"passed": F.col("outcome.passed")}
    return histogram(transitions(spark, sf_dir).select("schema_version", "source_outcome", "outcome", "validation", "structured_action"), fields)


@query("a15_confusion", f"WITH {TR} SELECT prompt_jepa_target.summary.outcome_status AS expected, outcome.status AS predicted, count(*) AS n FROM tr GROUP BY 1, 2")
def a15(spark, sf_dir):
    return confusion(transitions(spark, sf_dir).select("prompt_jepa_target", "outcome"), F.col("prompt_jepa_target.summary.outcome_status"), F.col("outcome.status"))


@query("a16_field_accuracy", f"""WITH {TR}, x AS (SELECT prompt_jepa_target.summary.action_kind IS NOT DISTINCT FROM structured_action.kind AS a, prompt_jepa_target.summary.outcome_kind IS NOT DISTINCT FROM outcome.kind AS b, prompt_jepa_target.summary.outcome_status IS NOT DISTINCT FROM outcome.status AS c FROM tr)
SELECT count(*) AS rows_, round(avg(a::INT), 6) AS action_kind, round(avg(b::INT), 6) AS outcome_kind, round(avg(c::INT), 6) AS outcome_status, round(avg((a AND b AND c)::INT), 6) AS exact FROM x""")
def a16(spark, sf_dir):
    df = transitions(spark, sf_dir)
    s = F.col("prompt_jepa_target.summary")
    same = {"action_kind": s["action_kind"].eqNullSafe(F.col("structured_action.kind")), "outcome_kind": s["outcome_kind"].eqNullSafe(F.col("outcome.kind")), "outcome_status": s["outcome_status"].eqNullSafe(F.col("outcome.status"))}
    every = same["action_kind"] & same["outcome_kind"] & same["outcome_status"]
    return df.agg(F.count("*").alias("rows_"), *[F.round(F.avg(c.cast("int")), 6).alias(n) for n, c in same.items()], F.round(F.avg(every.cast("int")), 6).alias("exact"))


_SETS = f"""WITH {C}, x AS (SELECT list_distinct(list_filter(equivalent_candidate_ranks, lambda v: v IS NOT NULL)) AS e, list_distinct(list_filter(overlapping_candidate_ranks, lambda v: v IS NOT NULL)) AS p FROM c WHERE equivalent_candidate_ranks IS NOT NULL AND overlapping_candidate_ranks IS NOT NULL),
n AS (SELECT len(list_intersect(e, p)) AS tp, len(p) - len(list_intersect(e, p)) AS fp, len(e) - len(list_intersect(e, p)) AS fn FROM x)"""


@query("a17_multilabel", _SETS + " SELECT count(*) AS rows_, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, coalesce(round(sum(tp) / nullif(sum(tp) + sum(fp), 0), 6), 0) AS precision_, coalesce(round(sum(tp) / nullif(sum(tp) + sum(fn), 0), 6), 0) AS recall, count(*) FILTER (WHERE fp = 0 AND fn = 0) AS exact FROM n")
def a17(spark, sf_dir):
    df = outcomes(spark, sf_dir, "equivalent_candidate_ranks", "overlapping_candidate_ranks").where("equivalent_candidate_ranks is not null and overlapping_candidate_ranks is not null")
    e, p = (F.array_distinct(F.array_compact(c)) for c in ("equivalent_candidate_ranks", "overlapping_candidate_ranks"))
    n = df.select(F.size(F.array_intersect(e, p)).alias("tp"), F.size(F.array_except(p, e)).alias("fp"), F.size(F.array_except(e, p)).alias("fn"))
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    return n.agg(F.count("*").alias("rows_"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), ratio0(tp, tp + fp).alias("precision_"), ratio0(tp, tp + fn).alias("recall"), F.count_if((F.col("fp") == 0) & (F.col("fn") == 0)).alias("exact"))


@query("a18_residual_groups", f"WITH {TR} SELECT structured_action.repo_mode AS repo_mode, prompt_jepa_target.summary.outcome_status AS expected, outcome.status AS predicted, count(*) AS n, min(id) AS example FROM tr WHERE prompt_jepa_target.summary.outcome_status IS DISTINCT FROM outcome.status GROUP BY 1, 2, 3")
def a18(spark, sf_dir):
    df = transitions(spark, sf_dir).select("id", F.col("structured_action.repo_mode").alias("repo_mode"), F.col("prompt_jepa_target.summary.outcome_status").alias("expected"), F.col("outcome.status").alias("predicted"))
    return df.where(~F.col("expected").eqNullSafe(F.col("predicted"))).groupBy("repo_mode", "expected", "predicted").agg(F.count("*").alias("n"), F.min("id").alias("example"))


@query("a20_centroids", "SELECT label, i, round(avg(v), 6) AS mean, count(*) AS n FROM (SELECT label, (generate_subscripts(embedding, 1) - 1)::INT AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY 1, 2")
def a20(spark, sf_dir):
    return centroids(read(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v")), ["label"], "v")


@query("a21_totals", f"WITH {C} SELECT count(*) AS candidates, count(DISTINCT task) AS tasks, sum(diff_added_lines)::BIGINT AS added, sum(diff_removed_lines)::BIGINT AS removed, coalesce(bool_and(diff_added_lines >= 0), true) AS all_nonnegative FROM c")
def a21(spark, sf_dir):
    df = outcomes(spark, sf_dir, "diff_added_lines", "diff_removed_lines")
    per = df.groupBy("task").agg(F.count("*").alias("n"), F.sum("diff_added_lines").alias("a"), F.sum("diff_removed_lines").alias("r"), F.bool_and(F.col("diff_added_lines") >= 0).alias("k"))
    return per.agg(F.sum("n").alias("candidates"), F.count("task").alias("tasks"), F.sum("a").alias("added"), F.sum("r").alias("removed"), F.coalesce(F.bool_and("k"), F.lit(True)).alias("all_nonnegative"))


@query("a22_split_pass", f"WITH {C}, {_PLANS} SELECT split, count(*) AS plans, count(*) FILTER (WHERE first_passed) AS pass_at_1, count(*) FILTER (WHERE passing > 0) AS solved FROM plans GROUP BY split")
def a22(spark, sf_dir):
    return plans(spark, sf_dir).groupBy("split").agg(F.count("*").alias("plans"), F.count_if("first_passed").alias("pass_at_1"), F.count_if(F.col("passing") > 0).alias("solved"))


@query("a23_mean_or_null", f"WITH {C} SELECT action, round(avg(CASE WHEN isnan(failure_hint_score) THEN NULL ELSE failure_hint_score END), 6) AS mean_hint, count(*) FILTER (WHERE ast_parse_ok IS NOT TRUE) AS unparsed FROM c GROUP BY action")
def a23(spark, sf_dir):
    df = outcomes(spark, sf_dir, "action", "failure_hint_score", "ast_parse_ok")
    return df.groupBy("action").agg(F.round(F.avg(F.when(~F.isnan("failure_hint_score"), F.col("failure_hint_score"))), 6).alias("mean_hint"), F.count_if(~F.coalesce("ast_parse_ok", F.lit(False))).alias("unparsed"))


@query("a24_majority_label", f"WITH {C}, n AS (SELECT action, language, count(*) AS n FROM c WHERE language IS NOT NULL GROUP BY 1, 2) SELECT action, language AS majority, n FROM n QUALIFY row_number() OVER (PARTITION BY action ORDER BY n DESC, language) = 1")
def a24(spark, sf_dir):
    return majority(outcomes(spark, sf_dir, "action", "language").where(F.col("language").isNotNull()), ["action"], "language")


@query("a25_repo_state", f"""WITH {TR}, f AS (SELECT id, unnest(repo_before.state.files) AS f FROM tr), b AS (SELECT repo_before.state.aggregate.kind AS kind, count(*) AS states, sum(len(repo_before.state.files))::BIGINT AS files FROM tr WHERE repo_before IS NOT NULL GROUP BY 1)
SELECT kind, states, files FROM b""")
def a25(spark, sf_dir):
    df = transitions(spark, sf_dir).where(F.col("repo_before").isNotNull()).select(F.col("repo_before.state.aggregate.kind").alias("kind"), F.size("repo_before.state.files").alias("n"), F.col("repo_before.state.files").isNotNull().alias("has"))
    return df.groupBy("kind").agg(F.count("*").alias("states"), F.sum(F.when(F.col("has"), F.col("n"))).alias("files"))


@query("a25_state_bytes", f"WITH {TR}, f AS (SELECT structured_action.repo_mode AS repo_mode, unnest(repo_before.state.files) AS f FROM tr) SELECT repo_mode, count(f.path) AS files, sum(f.byte_count)::BIGINT AS bytes, count(*) FILTER (WHERE f.path LIKE '%test%') AS tests FROM f GROUP BY 1")
def a25_bytes(spark, sf_dir):
    f = transitions(spark, sf_dir).select(F.col("structured_action.repo_mode").alias("repo_mode"), F.explode("repo_before.state.files").alias("f"))
    return f.groupBy("repo_mode").agg(F.count("f.path").alias("files"), F.sum("f.byte_count").alias("bytes"), F.count_if(F.col("f.path").contains("test")).alias("tests"))


@query("a26_failed_reasons", f"WITH {C} SELECT reason, count(*) AS n FROM c WHERE passed IS NOT TRUE GROUP BY reason ORDER BY n DESC, reason NULLS LAST LIMIT 10")
def a26(spark, sf_dir):
    n = outcomes(spark, sf_dir, "reason").where(~F.coalesce("passed", F.lit(False))).groupBy("reason").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), F.col("reason").asc_nulls_last()).limit(10)


@query("a27_sizes", " UNION ALL ".join(f"SELECT '{t}' AS table_, count(*) AS rows_ FROM {t}" for t in ("tasks", "candidate_outcomes", "outcome_log", "prompt_repo_transitions", "mined_git_transitions", "documents")))
def a27(spark, sf_dir):
    out = None
    for t in ("tasks", "candidate_outcomes", "outcome_log", "prompt_repo_transitions", "mined_git_transitions", "documents"):
        one = read(spark, sf_dir, t).agg(F.count("*").alias("rows_")).select(F.lit(t).alias("table_"), "rows_")
        out = one if out is None else out.unionByName(one)
    return out


@query("a06_rank_metrics", f"""WITH {C}, s AS (SELECT task, ph, plan, candidate_id, passed, 'existing' AS strategy, row_number() OVER (PARTITION BY task, ph, plan ORDER BY rk, candidate_id) AS p FROM c
UNION ALL SELECT task, ph, plan, candidate_id, passed, 'model_score', row_number() OVER (PARTITION BY task, ph, plan ORDER BY CASE WHEN isnan(model_score) THEN NULL ELSE model_score END DESC NULLS LAST, rk, candidate_id) FROM c
UNION ALL SELECT task, ph, plan, candidate_id, passed, 'random', row_number() OVER (PARTITION BY task, ph, plan ORDER BY sha256('order:' || candidate_id), candidate_id) FROM c),
g AS (SELECT strategy, task, ph, plan, min(p) FILTER (WHERE passed) AS f, count(*) AS n FROM s GROUP BY ALL) SELECT strategy, count(*) AS groups, count(f) AS solved, count(*) FILTER (WHERE f = 1) AS pass_at_1, count(*) FILTER (WHERE f <= 3) AS pass_at_k,
round(count(*) FILTER (WHERE f = 1) / count(*), 6) AS pass_at_1_rate, round(sum(coalesce(1.0 / f, 0)) / count(*), 6) AS mrr, coalesce(round(sum(1.0 / f) / nullif(count(f), 0), 6), 0) AS mrr_solved, round(avg(f), 6) AS avg_first, round(avg(coalesce(f - 1, n)), 6) AS avg_before, count(f) - count(*) FILTER (WHERE f = 1) AS residual FROM g GROUP BY strategy""".replace("GROUP BY ALL", "GROUP BY strategy, task, ph, plan"))
def a06(spark, sf_dir):
    """Strategies side by side. The place of the first pass under a strategy is one more than the candidates before it:
    the best key among the passing ones is an aggregate, and the count of smaller keys another, so no group is sorted."""
    df = outcomes(spark, sf_dir, "model_score")
    last = F.lit(1.7e308)
    keys = {
        "existing": F.struct(F.coalesce(F.col("rank_index").cast("double"), last), F.lit(""), F.col("candidate_id")),
        "model_score": F.struct(F.coalesce(-F.when(~F.isnan("model_score"), F.col("model_score")), last), F.lpad(F.coalesce(F.col("rank_index"), F.lit(1 << 62)).cast("string"), 20, "0"), F.col("candidate_id")),
        "random": F.struct(F.lit(0.0), F.sha2(F.concat(F.lit("order:"), F.col("candidate_id").cast("string")), 256), F.col("candidate_id")),
    }
    kinds = "struct<a:double,b:string,c:long>"
    rows = cut(df.select("candidate_id", group_text(*PLAN).alias("k"), F.coalesce("passed", F.lit(False)).alias("passed"), *[c.cast(kinds).alias(f"key_{s}") for s, c in keys.items()]), "rank-keys")
    best = rows.groupBy("k").agg(*[F.min(F.when(F.col("passed"), F.col(f"key_{s}"))).alias(f"best_{s}") for s in keys])
    both = skew_join(rows, best, ["k"], F.col("candidate_id"))
    wide = both.groupBy("k").agg(F.count("*").alias("n"), F.bool_or("passed").alias("has"), *[(F.count_if(F.col(f"key_{s}") < F.col(f"best_{s}")) + 1).alias(f"p_{s}") for s in keys])
    places = wide.select("n", "has", F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(f"p_{s}").alias("p")) for s in keys])).alias("x")).select("n", "has", "x.*")
    first = F.when(F.col("has"), F.col("p"))
    return places.groupBy("strategy").agg(*rank_metrics(first, F.col("n"), 3))
