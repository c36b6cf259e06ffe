"""Queries of sources, sinks and streams, and of predictors and gates."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from quarrymint.functions.vec import subtract
from quarrymint.operators.rollup import ratio
from quarrymint.plans.base import ORDER, PLAN, TR, C, T, outcomes, register, tasks, transitions
from quarrymint.plans.rollup_queries import _MODE, _PLANS, _mode, plans
from quarrymint.session import read, scratch_path
from quarrymint.sources.jsonl import inventory, read_strict, read_versioned, split_valid, with_provenance, write_jsonl
from quarrymint.streaming.logs import run_once, running_totals, stream_table, window_counts

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = partial(register, QUERIES, ORACLE)


@query("s01_k01_jsonl_round_trip", f"WITH {T} SELECT task_id, name, family, max_steps FROM t")
def s01(spark, sf):
    """Tasks written as JSON Lines and read back by the strict scan."""
    path = scratch_path(spark, "jsonl")
    write_jsonl(tasks(spark, sf).select("task_id", "name", "family", "max_steps"), path, ["task_id"])
    return read_strict(spark, path, "task_id long, name string, family string, max_steps long")


@query("s02_tolerant_scan", "WITH l AS (SELECT DISTINCT line_id, line FROM outcome_log) SELECT CASE WHEN line IS NULL OR trim(line) = '' THEN 'blank' WHEN NOT json_valid(line) THEN 'invalid' WHEN json_type(line::JSON) = 'OBJECT' THEN 'object' ELSE 'other' END AS kind, count(*) AS n FROM l GROUP BY 1")
def s02(spark, sf):
    lines = read(spark, sf, "outcome_log").select("line_id", "line").dropDuplicates(["line_id"])
    return split_valid(lines, "line").groupBy("kind").agg(F.count("*").alias("n"))


@query("s03_provenance", "WITH l AS (SELECT DISTINCT line_id, source_path FROM outcome_log) SELECT line_id, source_path, row_number() OVER (PARTITION BY source_path ORDER BY line_id) AS line_number FROM l")
def s03(spark, sf):
    lines = read(spark, sf, "outcome_log").select("line_id", "source_path").distinct()
    return with_provenance(lines, "source_path", "line_id").select("line_id", "source_path", "line_number")


@query("s04_versioned_scan", f"WITH {TR} SELECT schema_version, count(*) AS n FROM tr GROUP BY 1")
def s04(spark, sf):
    path = scratch_path(spark, "versioned")
    write_jsonl(transitions(spark, sf).select("id", "schema_version"), path, ["id"])
    return read_versioned(spark, path, "id string, schema_version string", "prompt-repo-transition-v1").groupBy("schema_version").agg(F.count("*").alias("n"))


@query("s05_usable_sources", "SELECT repo, count(DISTINCT transition_id) AS n FROM mined_git_transitions WHERE before_source IS NOT NULL AND after_source IS NOT NULL GROUP BY repo")
def s05(spark, sf):
    m = read(spark, sf, "mined_git_transitions").where("before_source is not null and after_source is not null").select("transition_id", "repo").distinct()
    return m.groupBy("repo").agg(F.count("*").alias("n"))


@query("s08_typed_dispatch", f"WITH {TR} SELECT source_outcome.record_kind AS record_kind, count(*) AS n, count(DISTINCT structured_action.kind) AS kinds FROM tr WHERE source_outcome.record_kind IS NOT NULL GROUP BY 1")
def s08(spark, sf):
    per = transitions(spark, sf).select(F.col("source_outcome.record_kind").alias("record_kind"), F.col("structured_action.kind").alias("k")).where("record_kind is not null").groupBy("record_kind", "k").agg(F.count("*").alias("c"))
    return per.groupBy("record_kind").agg(F.sum("c").alias("n"), F.count("k").alias("kinds"))


@query("s09_task_manifest", f"WITH {T} SELECT task_id, coalesce(nullif(trim(family), ''), 'unclassified') AS family, coalesce(source_type, 'handcrafted') AS source_type, coalesce(max_steps, 1) AS max_steps FROM t")
def s09(spark, sf):
    return tasks(spark, sf).select("task_id", F.coalesce(F.nullif(F.trim("family"), F.lit("")), F.lit("unclassified")).alias("family"), F.coalesce("source_type", F.lit("handcrafted")).alias("source_type"), F.coalesce("max_steps", F.lit(1)).alias("max_steps"))


@query("s13_k05_checksummed_bundle")
def s13(spark, sf):
    """Files of a written bundle with size and checksum."""
    path = scratch_path(spark, "bundle")
    write_jsonl(read(spark, sf, "split_targets"), f"{path}/split_targets", ["split"])
    write_jsonl(read(spark, sf, "source_targets"), f"{path}/source_targets", ["source"])
    return inventory(spark, path, "*.txt")


@query("k02_append_log", f"WITH {T} SELECT count(*) * 2 AS lines, count(DISTINCT task_id) AS tasks FROM t")
def k02(spark, sf):
    path = scratch_path(spark, "log")
    for _ in range(2):
        write_jsonl(tasks(spark, sf).select("task_id", "name"), path, ["task_id"], "append")
    per = read_strict(spark, path, "task_id long, name string").groupBy("task_id").agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("lines"), F.count("*").alias("tasks"))


@query("k04_candidate_export", f"WITH {C} SELECT candidate_id, rank_index, coalesce(passed, false) AS passed FROM c")
def k04(spark, sf):
    path = scratch_path(spark, "export")
    write_jsonl(outcomes(spark, sf).select("candidate_id", "rank_index", F.coalesce("passed", F.lit(False)).alias("passed")), path, ["candidate_id"])
    return read_strict(spark, path, "candidate_id long, rank_index long, passed boolean")


@query("st01_window_counts", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def st01(spark, sf):
    counts = run_once(window_counts(stream_table(spark, f"{sf}/events.parquet"), "ts", ["event_type"], "value", late="3650 days"), "complete")
    return counts.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", "total")


@query("st02_stream_static_join", "SELECT c_mktsegment, count(*) AS n, round(sum(value), 4) AS total FROM events JOIN customer ON c_custkey = user_id GROUP BY 1")
def st02(spark, sf):
    static = read(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    joined = stream_table(spark, f"{sf}/events.parquet").join(static, "user_id").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return run_once(joined, "complete")


@query("st03_running_totals", "SELECT user_id, count(*) AS n, round(coalesce(sum(value), 0), 4) AS total FROM events GROUP BY user_id")
def st03(spark, sf):
    rows = run_once(running_totals(stream_table(spark, f"{sf}/events.parquet"), "user_id", "value"), "update", ["user_id"])
    return rows.select("user_id", "n", F.round("total", 4).alias("total"))


# --- predictors and gates

_DELTA = f"""{TR}, d AS (SELECT id, structured_action.kind AS action, repo_before.state.repo_embedding AS a, repo_after.state.repo_embedding AS b FROM tr), ok AS (SELECT * FROM d WHERE a IS NOT NULL AND b IS NOT NULL AND len(a) = len(b) AND len(a) > 0),
l AS (SELECT id, action, len(a) AS dim, generate_subscripts(a, 1) AS i, unnest(list_transform(list_zip(a, b), lambda x: x[2] - x[1])) AS x FROM ok)"""


@query("m04_leave_one_out_error", f"WITH {_DELTA}, s AS (SELECT *, sum(x) OVER w AS s, count(x) OVER w AS n FROM l WINDOW w AS (PARTITION BY action, dim, i)), e AS (SELECT id, action, sum(abs(x - (s - x) / nullif(n - 1, 0))) / max(dim) AS e FROM s GROUP BY 1, 2) SELECT action, count(*) AS rows_, count(e) AS predicted, round(avg(e), 6) AS mean_error, round(max(e), 6) AS worst FROM e GROUP BY action")
def m04(spark, sf):
    """Each transition's change predicted by the mean change of the others with its action: (sum - x) / (n - 1)."""
    a, b = F.col("repo_before.state.repo_embedding"), F.col("repo_after.state.repo_embedding")
    d = transitions(spark, sf).where((F.size(a) == F.size(b)) & (F.size(a) > 0))
    d = d.select("id", F.col("structured_action.kind").alias("action"), F.size(a).alias("dim"), subtract(b, a).alias("x"))
    sums = d.select("action", "dim", F.posexplode("x").alias("i", "v")).groupBy("action", "dim", "i").agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    mean = sums.groupBy("action", "dim").agg(F.array_sort(F.collect_list(F.struct("i", "s", "n"))).alias("m"))  # as long as a vector
    on = [F.col("action").eqNullSafe(F.col("action_")), F.col("dim") == F.col("dim_")]
    j = d.join(mean.withColumnsRenamed({"action": "action_", "dim": "dim_"}), on)
    err = F.zip_with("x", "m", lambda x, m: F.abs(x - F.try_divide(m["s"] - x, m["n"] - 1)))
    e = j.select("action", (F.aggregate(err, F.lit(0.0), lambda t, v: t + v) / F.col("dim")).alias("e"))
    return e.groupBy("action").agg(F.count("*").alias("rows_"), F.count("e").alias("predicted"), F.round(F.avg("e"), 6).alias("mean_error"), F.round(F.max("e"), 6).alias("worst"))


@query("m13_strategy_readiness", f"""WITH {C}, g AS (SELECT task, ph, plan, arg_min(coalesce(passed, false), (rk, candidate_id)) AS a, arg_min(coalesce(passed, false), (-coalesce(CASE WHEN isnan(ranker_score) THEN NULL ELSE ranker_score END, -1e300), rk, candidate_id)) AS b FROM c GROUP BY 1, 2, 3), m AS (SELECT avg(a::INT) AS base, avg(b::INT) AS scorer FROM g)
SELECT round(base, 6) AS base, round(scorer, 6) AS scorer, round(scorer - base, 6) AS delta, CASE WHEN scorer < base THEN 'not_ready' WHEN scorer = base THEN 'ready_for_shadow_mode' ELSE 'ready_for_guarded_opt_in' END AS gate FROM m""")
def m13(spark, sf):
    ok = F.coalesce("passed", F.lit(False)).cast("int")
    score = F.struct((-F.coalesce(F.when(~F.isnan("ranker_score"), F.col("ranker_score")), F.lit(-1e300))).alias("s"), ORDER().alias("o"))
    m = outcomes(spark, sf, "ranker_score").groupBy(*PLAN).agg(F.min_by(ok, ORDER()).alias("a"), F.min_by(ok, score).alias("b")).agg(F.avg("a").alias("base"), F.avg("b").alias("scorer"))
    gate = F.when(F.col("scorer") < F.col("base"), "not_ready").when(F.col("scorer") == F.col("base"), "ready_for_shadow_mode").otherwise("ready_for_guarded_opt_in")
    return m.select(F.round("base", 6).alias("base"), F.round("scorer", 6).alias("scorer"), F.round(F.col("scorer") - F.col("base"), 6).alias("delta"), gate.alias("gate"))


@query("g04_residual_classes", f"WITH {C}, {_PLANS} SELECT family, CASE WHEN passing = 0 THEN 'candidate_generation_gap' ELSE 'scorer_ranking_gap' END AS residual, count(*) AS plans FROM plans WHERE NOT first_passed GROUP BY 1, 2")
def g04(spark, sf):
    return plans(spark, sf).where(~F.col("first_passed")).groupBy("family", F.when(F.col("passing") == 0, "candidate_generation_gap").otherwise("scorer_ranking_gap").alias("residual")).agg(F.count("*").alias("plans"))


@query("g05_failure_modes", f"WITH {C}, {_PLANS} SELECT {_MODE} AS mode, count(*) AS plans, round(count(*) / (SELECT count(*) FROM plans), 6) AS share FROM plans GROUP BY 1")
def g05(spark, sf):
    p = plans(spark, sf).groupBy(_mode().alias("mode")).agg(F.count("*").alias("plans"))
    total = p.agg(F.sum("plans").alias("t"))
    return p.join(F.broadcast(total), F.lit(True)).select("mode", "plans", ratio(F.col("plans"), F.col("t")).alias("share"))


@query("a19_transition_eval", f"WITH {TR}, x AS (SELECT outcome.kind = prompt_jepa_target.summary.outcome_kind AS hit, outcome.kind IS NOT NULL AND prompt_jepa_target.summary.outcome_kind IS NOT NULL AS applicable, len(repo_before.state.files) AS files FROM tr) SELECT count(*) AS rows_, count(*) FILTER (WHERE applicable) AS applicable, count(*) FILTER (WHERE hit) AS correct, round(count(*) FILTER (WHERE hit) / nullif(count(*) FILTER (WHERE applicable), 0), 6) AS accuracy, round(avg(files), 6) AS mean_files, min(files)::BIGINT AS least_files, max(files)::BIGINT AS most_files FROM x")
def a19(spark, sf):
    want, got, files = F.col("prompt_jepa_target.summary.outcome_kind"), F.col("outcome.kind"), F.when(F.col("repo_before.state.files").isNotNull(), F.size("repo_before.state.files"))
    both = want.isNotNull() & got.isNotNull()
    hit = F.coalesce(want == got, F.lit(False))
    return transitions(spark, sf).agg(F.count("*").alias("rows_"), F.count_if(both).alias("applicable"), F.count_if(hit).alias("correct"), ratio(F.count_if(hit), F.count_if(both)).alias("accuracy"), F.round(F.avg(files), 6).alias("mean_files"), F.min(files).cast("long").alias("least_files"), F.max(files).cast("long").alias("most_files"))


@query("a13_language_summary", "SELECT lang, source IS NULL AS no_source, count(*) AS docs, count(text) AS with_text, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2")
def a13(spark, sf):
    return read(spark, sf, "documents").groupBy("lang", F.col("source").isNull().alias("no_source")).agg(F.count("*").alias("docs"), F.count("text").alias("with_text"), F.sum("n_chars").alias("chars"))
