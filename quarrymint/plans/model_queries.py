"""Queries of index building, predicted targets, proposals, prototypes, rescoring, constraints and Python-backed features."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from quarrymint.functions.hashing import stable_fraction
from quarrymint.functions.python_udfs import gestalt_ratio
from quarrymint.functions.vec import add, normalize, subtract
from quarrymint.operators.learners import fit_pairwise
from quarrymint.operators.retrieval import encode_text, knn
from quarrymint.operators.rollup import ratio
from quarrymint.operators.transitions import evaluated, examples, predicted, ranked
from quarrymint.plans.base import ORDER, PLAN, TR, C, O, T, outcomes, register, tasks, transitions
from quarrymint.plans.order_queries import _Q, _features, _score, _vectors
from quarrymint.session import cut, read, scratch_path

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = partial(register, QUERIES, ORACLE)


@query("proj01_transition_bench_rows", f"WITH {TR} SELECT id, source_outcome.record_kind AS source_kind, structured_action.kind AS action, outcome.status AS status, coalesce(validation.status, 'missing') AS validation, len(validation.commands) AS commands, repo_before IS NOT NULL AS has_before, repo_after IS NOT NULL AS has_after FROM tr")
def proj01(spark, sf):
    n = F.when(F.col("validation.commands").isNotNull(), F.size("validation.commands")).cast("long")
    return transitions(spark, sf).select("id", F.col("source_outcome.record_kind").alias("source_kind"), F.col("structured_action.kind").alias("action"), F.col("outcome.status").alias("status"), F.coalesce("validation.status", F.lit("missing")).alias("validation"), n.alias("commands"), F.col("repo_before").isNotNull().alias("has_before"), F.col("repo_after").isNotNull().alias("has_after"))


@query("proj08_target_metadata", f"WITH {TR} SELECT id, concat_ws(',', 'action_kind=' || prompt_jepa_target.summary.action_kind, 'outcome_kind=' || prompt_jepa_target.summary.outcome_kind, 'outcome_status=' || prompt_jepa_target.summary.outcome_status) AS summary FROM tr")
def proj08(spark, sf):
    s = F.col("prompt_jepa_target.summary")
    parts = [F.concat(F.lit(f"{n}="), s[n]) for n in ("action_kind", "outcome_kind", "outcome_status")]
    return transitions(spark, sf).select("id", F.concat_ws(",", *parts).alias("summary"))


@query("proj16_outcome_labels", f"WITH {C} SELECT task, ph, plan, coalesce(bool_and(passed IS NOT NULL), false) AS known, CASE WHEN bool_or(passed) THEN 'passed' WHEN bool_and(passed IS NOT NULL) THEN 'failed' ELSE 'unknown' END AS label, min(rank_index) FILTER (WHERE passed) AS first_passing FROM c GROUP BY 1, 2, 3")
def proj16(spark, sf):
    known = F.bool_and(F.col("passed").isNotNull())
    label = F.when(F.bool_or(F.coalesce("passed", F.lit(False))), "passed").when(known, "failed").otherwise("unknown")
    return outcomes(spark, sf).groupBy(*PLAN).agg(known.alias("known"), label.alias("label"), F.min(F.when(F.col("passed"), F.col("rank_index"))).alias("first_passing"))


@query("proj17_parameter_defaults", f"WITH {T} SELECT task_id, coalesce(max_steps, 1) AS max_steps, coalesce(preferred.action, 'any') AS action, coalesce(len(map_keys(preferred.params)), 0) AS params FROM t")
def proj17(spark, sf):
    n = F.when(F.col("preferred.params").isNotNull(), F.size("preferred.params")).otherwise(0).cast("long")
    return tasks(spark, sf).select("task_id", F.coalesce("max_steps", F.lit(1)).alias("max_steps"), F.coalesce("preferred.action", F.lit("any")).alias("action"), n.alias("params"))


@query("proj18_hint_summaries", f"WITH {C} SELECT candidate_id, list_sort(list_distinct(list_filter(list_transform(failure_hints, lambda h: h.exception_type), lambda x: x IS NOT NULL))) AS exceptions FROM c WHERE failure_hints IS NOT NULL")
def proj18(spark, sf):
    kinds = F.array_sort(F.array_distinct(F.array_compact(F.transform("failure_hints", lambda h: h["exception_type"]))))
    return outcomes(spark, sf, "failure_hints").where(F.col("failure_hints").isNotNull()).select("candidate_id", kinds.alias("exceptions"))


@query("f01_split_filter", f"WITH {T} SELECT count(*) AS train, count(*) > 0 AS usable FROM t WHERE lower(trim(split)) = 'train'")
def f01(spark, sf):
    return tasks(spark, sf).where(F.lower(F.trim("split")) == "train").agg(F.count("*").alias("train")).withColumn("usable", F.col("train") > 0)


@query("f05_changed_and_named", "WITH m AS (SELECT DISTINCT transition_id, commit, before_source, after_source FROM mined_git_transitions) SELECT count(*) AS rows_, count(*) FILTER (WHERE before_source IS DISTINCT FROM after_source AND coalesce(commit, '') <> '') AS changed FROM m")
def f05(spark, sf):
    m = read(spark, sf, "mined_git_transitions").select("transition_id", "commit", "before_source", "after_source").dropDuplicates(["transition_id"])
    return m.agg(F.count("*").alias("rows_"), F.count_if(~F.col("before_source").eqNullSafe(F.col("after_source")) & (F.coalesce("commit", F.lit("")) != "")).alias("changed"))


@query("v02_group_constraints", f"""WITH {C}, r AS (SELECT task, ph, plan, rank_index, count(*) AS k FROM c WHERE rank_index IS NOT NULL GROUP BY 1, 2, 3, 4), d AS (SELECT task, ph, plan, max(k) > 1 AS repeated FROM r GROUP BY 1, 2, 3), g AS (SELECT task, ph, plan, min(rank_index) FILTER (WHERE passed) AS first_passing, max(first_passing_index) AS stated, count(*) FILTER (WHERE passed) AS passing, max(passing_candidates) AS stated_passing FROM c GROUP BY 1, 2, 3)
SELECT count(*) FILTER (WHERE coalesce(repeated, false)) AS repeated_ranks, count(*) FILTER (WHERE first_passing IS DISTINCT FROM stated) AS wrong_first, count(*) FILTER (WHERE passing IS DISTINCT FROM stated_passing) AS wrong_count FROM g LEFT JOIN d ON d.task = g.task AND d.ph = g.ph AND d.plan IS NOT DISTINCT FROM g.plan""")
def v02(spark, sf):
    df = outcomes(spark, sf, "first_passing_index", "passing_candidates")
    by_rank = df.groupBy(*PLAN, "rank_index").agg(F.count("*").alias("k"), F.max(F.when(F.col("passed"), 1).otherwise(0)).alias("p"), F.count_if("passed").alias("passing"), F.max("first_passing_index").alias("stated"), F.max("passing_candidates").alias("stated_passing"))
    g = by_rank.groupBy(*PLAN).agg(
        F.coalesce(F.max(F.when(F.col("rank_index").isNotNull(), F.col("k"))), F.lit(0)).alias("most"), F.min(F.when(F.col("p") == 1, F.col("rank_index"))).alias("first_passing"), F.max("stated").alias("stated"), F.sum("passing").alias("passing"), F.max("stated_passing").alias("stated_passing")
    )
    return g.agg(F.count_if(F.col("most") > 1).alias("repeated_ranks"), F.count_if(~F.col("first_passing").eqNullSafe(F.col("stated"))).alias("wrong_first"), F.count_if(~F.col("passing").eqNullSafe(F.col("stated_passing"))).alias("wrong_count"))


@query("v06_required_fields", f"WITH {T}, i AS (SELECT unnest(list_filter([CASE WHEN coalesce(trim(name), '') = '' THEN 'error:name' END, CASE WHEN coalesce(trim(prompt), '') = '' THEN 'error:prompt' END, CASE WHEN coalesce(trim(family), '') = '' THEN 'warning:family' END, CASE WHEN coalesce(trim(repo), '') = '' THEN 'warning:repo' END], lambda x: x IS NOT NULL)) AS issue FROM t) SELECT issue, count(*) AS n FROM i GROUP BY issue")
def v06(spark, sf):
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules = {"error:name": "name", "error:prompt": "prompt", "warning:family": "family", "warning:repo": "repo"}
    return tasks(spark, sf).select(F.explode(F.array_compact(F.array(*[F.when(blank(c), F.lit(i)) for i, c in rules.items()]))).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@query("x06_weighted_features", f"WITH {TR}, w AS (SELECT id, 6.0 AS w FROM tr WHERE structured_action.kind IS NOT NULL UNION ALL SELECT id, 4.0 FROM tr WHERE outcome.kind IS NOT NULL UNION ALL SELECT id, 2.0 FROM tr WHERE validation.status IS NOT NULL) SELECT id, sum(w)::DOUBLE AS weight, count(*) AS features FROM w GROUP BY id")
def x06(spark, sf):
    fields = {"structured_action.kind": 6.0, "outcome.kind": 4.0, "validation.status": 2.0}
    parts = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(w)) for c, w in fields.items()]))
    return transitions(spark, sf).select("id", F.explode(parts).alias("w")).groupBy("id").agg(F.sum("w").alias("weight"), F.count("*").alias("features"))


@query("x11_safe_ratios", f"WITH {C} SELECT action, round(count(*) FILTER (WHERE passed) / nullif(count(*) FILTER (WHERE preferred), 0), 6) AS or_null, coalesce(round(count(*) FILTER (WHERE passed) / nullif(count(*) FILTER (WHERE preferred), 0), 6), 0) AS or_zero FROM c GROUP BY action")
def x11(spark, sf):
    r = ratio(F.count_if("passed"), F.count_if("preferred"))
    return outcomes(spark, sf, "action", "preferred").groupBy("action").agg(r.alias("or_null"), F.coalesce(r, F.lit(0.0)).alias("or_zero"))


@query("x19_gestalt_ratio")
def x19(spark, sf):
    """How alike a task's name and its family are, letter by letter."""
    return tasks(spark, sf).select("task_id", F.round(gestalt_ratio(F.col("name"), F.col("family")), 6).alias("ratio"))


@query("x21_candidate_features", f"WITH {C}, f AS (SELECT 'action=' || action AS f FROM c UNION ALL SELECT 'node=' || node_kind FROM c WHERE node_kind IS NOT NULL UNION ALL SELECT 'param:' || k FROM (SELECT unnest(map_keys(params)) AS k FROM c) UNION ALL SELECT 'single_line' FROM c WHERE edit_is_single_line) SELECT f AS feature, count(*) AS n FROM f GROUP BY f")
def x21(spark, sf):
    raw = read(spark, sf, "candidate_outcomes").select("candidate_id", "action", "node_kind", F.map_keys("params").alias("keys"), "edit_is_single_line").dropDuplicates(["candidate_id"])
    keys = F.coalesce(F.transform("keys", lambda k: F.concat(F.lit("param:"), k)), F.array().cast("array<string>"))
    own = F.array(F.concat(F.lit("action="), "action"), F.concat(F.lit("node="), "node_kind"), F.when(F.col("edit_is_single_line"), "single_line"))
    return raw.select(F.explode(F.array_compact(F.concat(own, keys))).alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))


@query("x30_guard_flags", f"WITH {C}, {O}, b AS (SELECT task, ph, plan, bool_or(action = 'insert_guard') AS has_guard FROM c GROUP BY 1, 2, 3) SELECT count(*) FILTER (WHERE o.action = 'insert_guard') AS guards, count(*) FILTER (WHERE o.action <> 'insert_guard' AND has_guard) AS beside_a_guard FROM o JOIN b ON b.task = o.task AND b.ph = o.ph AND b.plan IS NOT DISTINCT FROM o.plan")
def x30(spark, sf):
    g = outcomes(spark, sf, "action").groupBy(*PLAN).agg(F.count("*").alias("n"), F.count_if(F.col("action") == "insert_guard").alias("k"))
    return g.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("guards"), F.coalesce(F.sum(F.when(F.col("k") > 0, F.col("n") - F.col("k"))), F.lit(0)).alias("beside_a_guard"))


@query("r02_r03_target_index")
def r02(spark, sf):
    """Index of transitions: hashed vectors of their target summaries, written and read back as a table."""
    s = F.col("prompt_jepa_target.summary")
    feats = F.array_compact(F.array(*[F.concat(F.lit(f"{n}="), s[n]) for n in ("action_kind", "outcome_kind", "outcome_status")]))
    v = encode_text(transitions(spark, sf).select("id", feats.alias("f")), "id", F.col("f"), 32)
    path = scratch_path(spark, "index")
    v.write.parquet(path)
    back = spark.read.parquet(path)
    return back.agg(F.count("*").alias("rows_"), F.count_distinct("id").alias("ids"), F.min(F.size("v")).alias("dim"))


_S5 = "s AS (SELECT q.vec_id AS query, e.vec_id AS id, round(list_cosine_similarity(q.v, e.v), 6) + 0.0 AS score FROM q JOIN e ON q.vec_id <> e.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS k FROM s)"


@query("r06_proposals", f"WITH {_Q}, {_S5}, p AS (SELECT query, max(id) FILTER (WHERE k = 1) AS nearest, max(score) FILTER (WHERE k = 1) AS score, max(score) FILTER (WHERE k = 1) - max(score) FILTER (WHERE k = 2) AS margin FROM r WHERE k <= 3 GROUP BY query) SELECT query, nearest, score, round(margin, 6) AS margin, score >= 0.08 AS clear, CASE WHEN score >= 0.25 THEN 'high' WHEN score >= 0.10 THEN 'medium' WHEN score >= 0.08 THEN 'low' ELSE 'none' END AS confidence FROM p")
def r06(spark, sf):
    p = _vectors(spark, sf)
    near = knn(p, p.where(F.col("id") % 20 == 0), 3)
    at = lambda c, k: F.max(F.when(F.col("rank") == k, F.col(c)))
    s = F.col("score")
    g = near.groupBy("query").agg(at("id", 1).alias("nearest"), at("score", 1).alias("score"), F.round(at("score", 1) - at("score", 2), 6).alias("margin"))
    return g.withColumn("clear", s >= 0.08).withColumn("confidence", F.when(s >= 0.25, "high").when(s >= 0.10, "medium").when(s >= 0.08, "low").otherwise("none"))


@query("r05_r08_predicted_targets")
def r05(spark, sf):
    """Targets predicted for every 20th vector: itself plus the change from its nearest neighbour to that one's nearest,
    normalized, then searched again."""
    p = _vectors(spark, sf)
    q = p.where(F.col("id") % 20 == 0)
    one = knn(p, q, 1).select(F.col("query"), F.col("id").alias("near"))
    two = knn(p, p.join(one.select(F.col("near").alias("id")).distinct(), "id", "left_semi"), 1).select(F.col("query").alias("near"), F.col("id").alias("target"))
    vec = lambda name: p.select(F.col("id").alias(name), F.col("v").alias(f"v_{name}"))
    moved = one.join(two, "near").join(vec("query"), "query").join(vec("near"), "near").join(vec("target"), "target")
    guess = moved.select(F.col("query").alias("id"), normalize(add(F.col("v_query"), subtract(F.col("v_target"), F.col("v_near")))).alias("v"))
    return knn(p, guess, 3)


def _predicted_hits(spark, sf):
    """For every query of r05: its label, its nearest result and label, and whether its label is among the 3 results'."""
    near = r05(spark, sf)
    e = read(spark, sf, "embeddings")
    j = near.join(e.select(F.col("vec_id").alias("query"), F.col("label").alias("expected")), "query").join(e.select(F.col("vec_id").alias("id"), "label"), "id")
    first = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c)))
    hit = F.coalesce(F.col("label") == F.col("expected"), F.lit(False))
    return j.where(F.col("expected").isNotNull()).groupBy("query", "expected").agg(first("id").alias("nearest"), first("score").alias("score"), first("label").alias("nearest_label"), F.bool_or(hit & (F.col("rank") == 1)).alias("hit_1"), F.bool_or(hit).alias("hit_3"))


@query("r08_predicted_target_accuracy")
def r08(spark, sf):
    """Accuracy of the labels that r05's predicted targets retrieve, and the queries missed."""
    one, three = F.count_if("hit_1"), F.count_if("hit_3")
    return _predicted_hits(spark, sf).agg(F.count("*").alias("queries"), one.alias("top_1"), three.alias("top_3"), ratio(one, F.count("*")).alias("top_1_accuracy"), ratio(three, F.count("*")).alias("top_3_accuracy"), F.count_if(~F.col("hit_1")).alias("missed_top_1"), F.count_if(~F.col("hit_3")).alias("missed_top_3"))


@query("r08_misses")
def r08_misses(spark, sf):
    """The first 20 queries whose nearest result has another label."""
    return _predicted_hits(spark, sf).where(~F.col("hit_1")).orderBy("query").limit(20)


@query("r09_mode_comparison", f"WITH {_Q}, {_S5}, d AS (SELECT q.vec_id AS query, e.vec_id AS id, round(list_distance(q.v, e.v), 6) + 0.0 AS score FROM q JOIN e ON q.vec_id <> e.vec_id), f AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score, id) AS k FROM d) SELECT count(*) AS both_modes, count(*) FILTER (WHERE r.id = f.id) AS same_nearest FROM r JOIN f ON f.query = r.query AND f.k = 1 WHERE r.k = 1")
def r09(spark, sf):
    p = _vectors(spark, sf)
    q = p.where(F.col("id") % 20 == 0)
    a, b = knn(p, q, 1).select("query", F.col("id").alias("a")), knn(p, q, 1, "euclidean").select("query", F.col("id").alias("b"))
    return a.join(b, "query").agg(F.count("*").alias("both_modes"), F.count_if(F.col("a") == F.col("b")).alias("same_nearest"))


def every_20th(ex):
    return ex.where(F.regexp_extract("id", r"(\d+)$", 1).cast("long") % 20 == 0)


@query("m03_predictions")
def m03_predictions(spark, sf):
    """Targets predicted for every 20th transition from its nearest other example by input vector."""
    ex = cut(examples(transitions(spark, sf)), "examples")
    q = every_20th(ex)
    return predicted(ex, q, ranked(ex, q, "input", 1), False)


def _evaluated(spark, sf):
    ex = cut(examples(transitions(spark, sf)), "examples")
    return evaluated(ex, every_20th(ex))


@query("m04_evaluation")
def m04_evaluation(spark, sf):
    """M04 over every 20th transition: hits among the nearest 3 and distances, of V0 and of the nearest prompt."""
    e = cut(_evaluated(spark, sf)[0], "evaluated")
    fields = ("outcome_kind", "validation_status")
    cols = []
    for f in fields:
        total, one, top = F.count(f"expected_{f}"), F.count_if(F.col(f"expected_{f}") == F.col(f"predicted_{f}")), F.count_if(f"top_k_{f}")
        cols += [total.alias(f"{f}_total"), one.alias(f"{f}_top_1"), top.alias(f"{f}_top_3"), ratio(one, total).alias(f"{f}_top_1_accuracy"), ratio(top, total).alias(f"{f}_top_3_accuracy")]
    d = F.col("distance")
    return e.groupBy("model").agg(F.count("*").alias("rows_"), *cols, F.count_if("applicable").alias("applicable"), F.count(d).alias("predicted"), F.round(F.avg(d), 6).alias("mean_distance"), F.min(d).alias("least"), F.max(d).alias("most"))


@query("m04_residuals")
def m04_residuals(spark, sf):
    """The 20 worst predictions of m04_evaluation: missed ones first, then by distance and id, the largest first."""
    both, v0 = _evaluated(spark, sf)
    prompt = both.where(F.col("model") == "prompt_only").select("id", F.col("nearest").alias("prompt_nearest"), F.col("is_residual").alias("prompt_missed"))
    worst = v0.where(F.col("is_residual") | F.col("distance").isNotNull()).orderBy(F.desc("is_residual"), F.coalesce("distance", F.lit(-1.0)).desc(), F.desc("id")).limit(20)
    return worst.drop("model").join(prompt, "id", "left")


@query("m05_before_after_prototypes", f"WITH {TR}, x AS (SELECT 'before' AS side, structured_action.kind AS action, len(repo_before.state.repo_embedding) AS dim, generate_subscripts(repo_before.state.repo_embedding, 1) - 1 AS i, unnest(repo_before.state.repo_embedding) AS v FROM tr UNION ALL SELECT 'after', structured_action.kind, len(repo_after.state.repo_embedding), generate_subscripts(repo_after.state.repo_embedding, 1) - 1, unnest(repo_after.state.repo_embedding) FROM tr) SELECT side, action, dim::INT AS dim, i::INT AS i, round(round(sum(v), 6) / count(v), 6) AS mean FROM x GROUP BY 1, 2, 3, 4")
def m05(spark, sf):
    tr = transitions(spark, sf).select(F.col("structured_action.kind").alias("action"), F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"repo_{s}.state.repo_embedding").alias("v")) for s in ("before", "after")])).alias("x")).select("action", "x.*")
    long = tr.select("side", "action", F.size("v").alias("dim"), F.posexplode("v").alias("i", "y"))
    return long.groupBy("side", "action", "dim", "i").agg(F.round(F.round(F.sum("y"), 6) / F.count("y"), 6).alias("mean"))


@query("m08_rescored_validation", f"WITH {C}, s AS (SELECT *, 2.0 * coalesce(CASE WHEN isnan(model_score) THEN NULL ELSE model_score END, 0) + 0.05 * coalesce(CASE WHEN isnan(failure_hint_score) THEN NULL ELSE failure_hint_score END, 0) - 0.1 * coalesce(diff_added_lines, 0) AS s FROM c), g AS (SELECT task, ph, plan, arg_min(coalesce(passed, false), (rk, candidate_id)) AS old, arg_min(coalesce(passed, false), (-round(s, 6), rk, candidate_id)) AS new FROM s GROUP BY 1, 2, 3) SELECT count(*) AS plans, count(*) FILTER (WHERE new AND NOT old) AS gained, count(*) FILTER (WHERE old AND NOT new) AS lost FROM g")
def m08(spark, sf):
    f = _features(spark, sf).withColumn("s", F.round(2.0 * F.col("f0") + 0.05 * F.col("f1") - 0.1 * F.col("f2"), 6))
    ok = F.coalesce("passed", F.lit(False))
    g = f.groupBy(*PLAN).agg(F.min_by(ok, ORDER()).alias("old"), F.min_by(ok, F.struct((-F.col("s")).alias("s"), ORDER().alias("o"))).alias("new"))
    return g.agg(F.count("*").alias("plans"), F.count_if(F.col("new") & ~F.col("old")).alias("gained"), F.count_if(F.col("old") & ~F.col("new")).alias("lost"))


@query("m11_m12_fit_and_holdout")
def m11(spark, sf):
    """A margin ranker fitted on three quarters of the families (by hash), its pass@1 on the rest beside the stored order."""
    df = outcomes(spark, sf, "model_score", "failure_hint_score", "diff_added_lines", "task_family")
    f = df.select("candidate_id", *PLAN, "passed", "rank_index", F.coalesce("task_family", F.lit("-")).alias("family"), F.coalesce(_score("model_score"), F.lit(0.0)).alias("f0"), F.coalesce(_score("failure_hint_score"), F.lit(0.0)).alias("f1"), F.coalesce(F.col("diff_added_lines").cast("double"), F.lit(0.0)).alias("f2"))
    f = f.withColumn("held", stable_fraction(F.concat(F.lit("v3:"), "family")) < 0.25)
    ok, x = F.coalesce("passed", F.lit(False)), F.array("f0", "f1", "f2")
    g = f.where(~F.col("held")).groupBy(*PLAN).agg(F.min_by(F.when(ok, x), F.when(ok, ORDER())).alias("p"), F.min_by(F.when(~ok, x), F.when(~ok, ORDER())).alias("q"), F.min("candidate_id").alias("key")).where("p is not null and q is not null")
    w = fit_pairwise(g.select("key", F.zip_with("p", "q", lambda a, b: a - b).alias("diff")), "key", ["f0", "f1", "f2"], 30, 0.1)
    s = sum((F.col(n) * v for n, v in sorted(w.items())), F.lit(0.0))
    held = f.where("held").groupBy(*PLAN).agg(F.min_by(ok, ORDER()).alias("old"), F.min_by(ok, F.struct((-F.round(s, 6)).alias("s"), ORDER().alias("o"))).alias("new"))
    return held.agg(F.count("*").alias("plans"), F.count_if("old").alias("stored_pass_at_1"), F.count_if("new").alias("fitted_pass_at_1"))


@query("u01_mixed_index", f"WITH {T}, {TR}, x AS (SELECT 'task:' || task_id AS id FROM t UNION ALL SELECT 'transition:' || id FROM tr) SELECT count(*) AS rows_, count(DISTINCT id) AS ids FROM x")
def u01(spark, sf):
    x = tasks(spark, sf).select(F.concat(F.lit("task:"), F.col("task_id").cast("string")).alias("id")).unionByName(transitions(spark, sf).select(F.concat(F.lit("transition:"), "id").alias("id")))
    return x.groupBy("id").agg(F.count("*").alias("k")).agg(F.sum("k").alias("rows_"), F.count("*").alias("ids"))


@query("a14_label_presence", f"WITH {TR} SELECT structured_action.repo_mode AS repo_mode, count(prompt_jepa_target.summary.outcome_status) AS applicable, count(*) FILTER (WHERE prompt_jepa_target.summary.outcome_status = outcome.status) AS correct FROM tr GROUP BY 1")
def a14(spark, sf):
    want = F.col("prompt_jepa_target.summary.outcome_status")
    return transitions(spark, sf).groupBy(F.col("structured_action.repo_mode").alias("repo_mode")).agg(F.count(want).alias("applicable"), F.count_if(want == F.col("outcome.status")).alias("correct"))
