"""Queries of the join operators and set operations."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from quarrymint.operators.joins import bounded_walk, leave_one_out, one_per_key, outer_with_status, overlap_counts
from quarrymint.operators.ranking import movement, pass_change
from quarrymint.operators.rollup import ratio
from quarrymint.plans.base import ORDER, PLAN, TR, C, T, outcomes, register, tasks, transitions
from quarrymint.plans.rollup_queries import _PLANS, plans
from quarrymint.session import cut, read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = partial(register, QUERIES, ORACLE)


@query("j01_full_outer_status", f"""WITH {C}, {T}, a AS (SELECT name AS task, count(*) AS n FROM t GROUP BY name), b AS (SELECT task, count(*) AS candidates FROM c GROUP BY task)
SELECT coalesce(a.task, b.task) AS task, n AS advice_rows, candidates, CASE WHEN a.task IS NULL THEN 'unjoined_outcomes' WHEN b.task IS NULL THEN 'unjoined_advice' ELSE 'joined' END AS join_status, CASE WHEN a.task IS NULL OR b.task IS NULL THEN CASE WHEN coalesce(trim(coalesce(a.task, b.task)), '') = '' THEN 'missing_task' ELSE 'no_match' END END AS unjoined_reason FROM a FULL OUTER JOIN b ON a.task = b.task AND trim(a.task) <> ''""")
def j01(spark, sf):
    a = tasks(spark, sf).groupBy(F.col("name").alias("task")).agg(F.count("*").alias("advice_rows"))
    b = outcomes(spark, sf).groupBy("task").agg(F.count("*").alias("candidates"))
    return outer_with_status(a, b, ["task"], "advice", "outcomes").select("task", "advice_rows", "candidates", "join_status", "unjoined_reason")


@query("a08_join_summary", f"""WITH {C}, {T}, a AS (SELECT DISTINCT name AS task FROM t), b AS (SELECT DISTINCT task FROM c)
SELECT s.s AS join_status, count(j.s) AS n FROM (VALUES ('joined'), ('unjoined_advice'), ('unjoined_outcomes')) s(s) LEFT JOIN (SELECT CASE WHEN a.task IS NULL THEN 'unjoined_outcomes' WHEN b.task IS NULL THEN 'unjoined_advice' ELSE 'joined' END AS s FROM a FULL OUTER JOIN b ON a.task = b.task) j ON j.s = s.s GROUP BY 1""")
def a08(spark, sf):
    n = j01(spark, sf).groupBy("join_status").agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(s,) for s in ("joined", "unjoined_advice", "unjoined_outcomes")], "join_status string")
    return every.join(n, "join_status", "left").select("join_status", F.coalesce("n", F.lit(0)).alias("n"))


_FIRST = "SELECT name, source_type, task_id FROM t QUALIFY row_number() OVER (PARTITION BY name ORDER BY created_at {0}, task_id {0}) = 1"


@query("j02_inner_first_wins", f"WITH {C}, {T}, f AS ({_FIRST.format('ASC')}) SELECT f.source_type, count(*) AS n FROM c JOIN f ON f.name = c.task GROUP BY 1")
def j02(spark, sf):
    one = one_per_key(tasks(spark, sf).select(F.col("name").alias("task"), "source_type", "task_id", "created_at"), ["task"], F.struct("created_at", "task_id"))
    return outcomes(spark, sf).join(one, "task").groupBy("source_type").agg(F.count("*").alias("n"))


@query("j03_left_last_wins", f"WITH {C}, {T}, f AS ({_FIRST.format('DESC')}), x AS (SELECT f.task_id FROM c LEFT JOIN f ON f.name = c.task) SELECT count(*) AS rows_, count(task_id) AS matched, (SELECT count(*) FROM f WHERE name NOT IN (SELECT task FROM c)) AS unused FROM x")
def j03(spark, sf):
    one = one_per_key(tasks(spark, sf).select(F.col("name").alias("task"), "task_id", "created_at"), ["task"], F.struct("created_at", "task_id"), last=True)
    c = outcomes(spark, sf)
    x = c.join(one, "task", "left").agg(F.count("*").alias("rows_"), F.count("task_id").alias("matched"))
    unused = one.join(c.select("task").distinct(), "task", "left_anti").agg(F.count("*").alias("unused"))
    return x.join(F.broadcast(unused), F.lit(True))


_MOVE = f"""WITH {C}, o AS (SELECT *, row_number() OVER (PARTITION BY task, ph ORDER BY rk, candidate_id) AS pos FROM c), f AS (SELECT task, min(pos) FILTER (WHERE passed AND ph = 'baseline') AS old, min(pos) FILTER (WHERE passed AND ph = 'ranked') AS new,
  bool_or(ph = 'baseline') AS has_old, bool_or(ph = 'ranked') AS has_new FROM o GROUP BY task)"""


@query("j04_w08_rank_movement", _MOVE + """ SELECT task, CASE WHEN old IS NULL AND new IS NULL THEN 'missing' WHEN old IS NULL THEN 'found' WHEN new IS NULL THEN 'lost' WHEN old = new THEN 'unchanged' WHEN old > new THEN '+' || (old - new) ELSE (old - new)::VARCHAR END AS movement,
CASE WHEN coalesce(old = 1, false) AND coalesce(new = 1, false) THEN 'kept' WHEN coalesce(old = 1, false) THEN 'lost' WHEN coalesce(new = 1, false) THEN 'gained' ELSE 'missed' END AS pass_change FROM f WHERE has_old AND has_new""")
def j04(spark, sf):
    from quarrymint.operators.ranking import numbered
    from quarrymint.plans.base import sort_order

    o = numbered(outcomes(spark, sf), ["task", "ph"], sort_order(), "pos")
    firsts = o.groupBy("task", "ph").agg(F.min(F.when(F.col("passed"), F.col("pos"))).alias("f"))
    old = firsts.where("ph = 'baseline'").select("task", F.col("f").alias("old"))
    new = firsts.where("ph = 'ranked'").select("task", F.col("f").alias("new"))
    return old.join(new, "task").select("task", movement(F.col("old"), F.col("new")).alias("movement"), pass_change(F.col("old"), F.col("new")).alias("pass_change"))


@query("j05_linked_ranks", f"WITH {C}, l AS (SELECT DISTINCT candidate_id, task, ph, plan, unnest(overlapping_candidate_ranks) AS r FROM c) SELECT l.candidate_id, count(DISTINCT l.r) AS linked, count(d.candidate_id) AS found FROM l LEFT JOIN c d ON d.task = l.task AND d.ph = l.ph AND d.plan = l.plan AND d.rank_index = l.r WHERE l.r IS NOT NULL GROUP BY 1")
def j05(spark, sf):
    c = outcomes(spark, sf, "overlapping_candidate_ranks")
    links = c.select("candidate_id", *PLAN, F.explode(F.array_distinct("overlapping_candidate_ranks")).alias("r")).where(F.col("r").isNotNull())
    per = c.groupBy(*PLAN, "rank_index").agg(F.count("*").alias("k"))
    j = links.join(per.withColumnRenamed("rank_index", "r"), [*PLAN, "r"], "left")
    return j.groupBy("candidate_id").agg(F.count("*").alias("linked"), F.coalesce(F.sum("k"), F.lit(0)).alias("found"))


@query("j06_star_left_joins", f"""WITH {C}, {T}, n AS (SELECT DISTINCT name FROM t), k AS (SELECT task, count(*) AS candidates, arg_max(action, (ingested_at, candidate_id)) AS last_action FROM c GROUP BY task), d AS (SELECT task, count(*) AS docs, sum(length(text))::BIGINT AS chars FROM documents WHERE task IS NOT NULL GROUP BY task)
SELECT n.name, coalesce(candidates, 0) AS candidates, last_action, coalesce(docs, 0) AS docs, chars FROM n LEFT JOIN k ON k.task = n.name LEFT JOIN d ON d.task = n.name""")
def j06(spark, sf):
    once = read(spark, sf, "candidate_outcomes").groupBy("task", "candidate_id").agg(F.min("ingested_at").alias("at"), F.first("action").alias("action"))
    k = once.groupBy(F.col("task").alias("name")).agg(F.count("*").alias("candidates"), F.max_by("action", F.struct("at", "candidate_id")).alias("last_action"))
    d = read(spark, sf, "documents").where(F.col("task").isNotNull()).groupBy(F.col("task").alias("name")).agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))
    n = tasks(spark, sf).select("name").distinct().join(k, "name", "left").join(d, "name", "left")
    return n.select("name", F.coalesce("candidates", F.lit(0)).alias("candidates"), "last_action", F.coalesce("docs", F.lit(0)).alias("docs"), "chars")


@query("j07_interval_overlaps", f"WITH {C} SELECT a.candidate_id, (SELECT count(*) FROM c b WHERE b.task = a.task AND b.ph = a.ph AND b.plan IS NOT DISTINCT FROM a.plan AND b.file_path = a.file_path AND b.candidate_id <> a.candidate_id AND a.start_line <= a.end_line AND b.start_line <= b.end_line AND a.start_line <= b.end_line AND b.start_line <= a.end_line) AS overlapping FROM c a")
def j07(spark, sf):
    df = outcomes(spark, sf, "file_path", "start_line", "end_line")
    return overlap_counts(df, [*PLAN, "file_path"], "start_line", "end_line").select("candidate_id", "overlapping")


@query("j10_leave_one_out", f"WITH {C}, s AS (SELECT candidate_id, task, CASE WHEN isnan(model_score) THEN NULL ELSE model_score END AS s FROM c), g AS (SELECT task, round(sum(s), 9) AS ss, count(s) AS n FROM s GROUP BY task) SELECT candidate_id, floor((ss - coalesce(s, 0)) / nullif(n - (s IS NOT NULL)::INT, 0) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS others_mean FROM s JOIN g USING (task)")
def j10(spark, sf):
    df = outcomes(spark, sf, "model_score").select("candidate_id", "task", F.when(~F.isnan("model_score"), F.col("model_score")).alias("s"))
    return leave_one_out(df, ["task"], "s").select("candidate_id", "others_mean")


@query("j11_pair_statistics", f"WITH {C}, s AS (SELECT task, ph, plan, passed, CASE WHEN isnan(model_score) THEN NULL ELSE model_score END AS s FROM c), p AS (SELECT task, ph, plan, count(*) FILTER (WHERE passed) * count(*) FILTER (WHERE passed IS NOT TRUE) AS pairs, avg(s) FILTER (WHERE passed) - avg(s) FILTER (WHERE passed IS NOT TRUE) AS margin FROM s GROUP BY ALL) SELECT task, ph, plan, pairs, round(margin, 6) AS mean_margin FROM p WHERE pairs > 0".replace("GROUP BY ALL", "GROUP BY task, ph, plan"))
def j11(spark, sf):
    """Positive x negative pairs of each plan: their number and mean score margin, in closed form."""
    ok = F.coalesce("passed", F.lit(False))
    s = F.when(~F.isnan("model_score"), F.col("model_score"))
    g = outcomes(spark, sf, "model_score").groupBy(*PLAN).agg((F.count_if(ok) * F.count_if(~ok)).alias("pairs"), F.round(F.avg(F.when(ok, s)) - F.avg(F.when(~ok, s)), 6).alias("mean_margin"))
    return g.where(F.col("pairs") > 0)


@query("j12_positive_negative_counts", f"WITH {C}, g AS (SELECT task, ph, plan, arg_min(candidate_id, (CASE WHEN preferred THEN 0 WHEN is_first_pass THEN 1 ELSE 2 END, rk, candidate_id)) FILTER (WHERE passed) AS positive, arg_min(coalesce(preferred, false), (CASE WHEN preferred THEN 0 WHEN is_first_pass THEN 1 ELSE 2 END, rk, candidate_id)) FILTER (WHERE passed) AS pref, count(*) FILTER (WHERE passed IS NOT TRUE) AS failing, count(*) FILTER (WHERE passed AND preferred IS NOT TRUE) AS others FROM c GROUP BY task, ph, plan) SELECT positive, failing + CASE WHEN pref THEN others ELSE 0 END AS negatives FROM g WHERE positive IS NOT NULL")
def j12(spark, sf):
    ok, pref = F.coalesce("passed", F.lit(False)), F.coalesce("preferred", F.lit(False))
    tier = F.struct(F.when(pref, 0).when(F.coalesce("is_first_pass", F.lit(False)), 1).otherwise(2).alias("t"), ORDER().alias("o"))
    g = outcomes(spark, sf, "preferred", "is_first_pass").groupBy(*PLAN).agg(F.min_by(F.when(ok, F.col("candidate_id")), F.when(ok, tier)).alias("positive"), F.min_by(F.when(ok, pref), F.when(ok, tier)).alias("pref"), F.count_if(~ok).alias("failing"), F.count_if(ok & ~pref).alias("others"))
    return g.where(F.col("positive").isNotNull()).select("positive", (F.col("failing") + F.when(F.col("pref"), F.col("others")).otherwise(0)).alias("negatives"))


@query("j13_rank_union", f"WITH {C} SELECT candidate_id, list_sort(list_distinct(list_concat(list_filter(coalesce(equivalent_candidate_ranks, []), lambda x: x IS NOT NULL), list_filter(coalesce(overlapping_candidate_ranks, []), lambda x: x IS NOT NULL)))) AS ranks, nullif(coalesce(list_position(overlapping_candidate_ranks, rank_index), 0), 0)::BIGINT AS own_place FROM c")
def j13(spark, sf):
    empty = F.array().cast("array<long>")
    df = outcomes(spark, sf, "equivalent_candidate_ranks", "overlapping_candidate_ranks")
    e, o = (F.array_compact(F.coalesce(c, empty)) for c in ("equivalent_candidate_ranks", "overlapping_candidate_ranks"))
    return df.select("candidate_id", F.array_sort(F.array_union(e, o)).alias("ranks"), F.nullif(F.array_position("overlapping_candidate_ranks", F.col("rank_index")), F.lit(0)).cast("long").alias("own_place"))


NAMES = ["issue_threads", "pytest_logs", "no_such_source", "pull_requests"]


@query("j14_ordered_selection", "WITH w AS (SELECT unnest(['issue_threads', 'pytest_logs', 'no_such_source', 'pull_requests']) AS source, generate_subscripts(['issue_threads', 'pytest_logs', 'no_such_source', 'pull_requests'], 1) AS place) SELECT place::BIGINT AS place, w.source, target_share, target_share IS NULL AS missing FROM w LEFT JOIN source_targets s ON s.source = w.source")
def j14(spark, sf):
    wanted = spark.createDataFrame([(i + 1, n) for i, n in enumerate(NAMES)], "place long, source string")
    goals = read(spark, sf, "source_targets").select("source", "target_share")
    return F.broadcast(wanted).join(goals, "source", "left").select("place", "source", "target_share", F.col("target_share").isNull().alias("missing"))


@query("j15_mode_comparison", f"WITH {C}, g AS (SELECT task, ph, plan, language, arg_min(coalesce(passed, false), (rk, candidate_id)) AS a, arg_min(coalesce(passed, false), (-coalesce(CASE WHEN isnan(model_score) THEN NULL ELSE model_score END, -1e300), rk, candidate_id)) AS b FROM c GROUP BY 1, 2, 3, 4) SELECT language, count(*) FILTER (WHERE b AND NOT a) AS fixed, count(*) FILTER (WHERE a AND NOT b) AS regressed, count(*) FILTER (WHERE NOT a AND NOT b) AS both_missed, count(*) FILTER (WHERE a AND b) AS both_hit FROM g GROUP BY language")
def j15(spark, sf):
    ok = F.coalesce("passed", F.lit(False))
    score = F.struct((-F.coalesce(F.when(~F.isnan("model_score"), F.col("model_score")), F.lit(-1e300))).alias("s"), ORDER().alias("o"))
    g = outcomes(spark, sf, "model_score", "language").groupBy(*PLAN, "language").agg(F.min_by(ok, ORDER()).alias("a"), F.min_by(ok, score).alias("b"))
    a, b = F.col("a"), F.col("b")
    return g.groupBy("language").agg(F.count_if(b & ~a).alias("fixed"), F.count_if(a & ~b).alias("regressed"), F.count_if(~a & ~b).alias("both_missed"), F.count_if(a & b).alias("both_hit"))


@query("j16_hint_max_score", f"WITH {C}, h AS (SELECT candidate_id, symbol, file_path, unnest(failure_hints) AS h FROM c) SELECT candidate_id, max((CASE WHEN list_contains(h.function_names, symbol) THEN 20 ELSE 0 END) + (CASE WHEN list_contains(h.source_files, string_split(file_path, '/')[-1]) THEN 10 ELSE 0 END))::BIGINT AS score FROM h WHERE h IS NOT NULL GROUP BY 1")
def j16(spark, sf):
    base = F.element_at(F.split("file_path", "/"), -1)
    yes = lambda c, n: F.when(c, n).otherwise(0)
    score = F.array_max(F.transform(F.filter("failure_hints", lambda h: h.isNotNull()), lambda h: yes(F.array_contains(h["function_names"], F.col("symbol")), 20) + yes(F.array_contains(h["source_files"], base), 10)))
    return outcomes(spark, sf, "failure_hints", "symbol", "file_path").select("candidate_id", score.cast("long").alias("score")).where(F.col("score").isNotNull())


@query("j17_document_task_lookup", f"WITH {T}, n AS (SELECT DISTINCT name FROM t) SELECT n.name IS NOT NULL AS known, d.task IS NOT NULL AS named, count(*) AS docs FROM documents d LEFT JOIN n ON n.name = d.task GROUP BY 1, 2")
def j17(spark, sf):
    n = tasks(spark, sf).select(F.col("name").alias("task")).distinct().withColumn("k", F.lit(True))
    return read(spark, sf, "documents").select("task").join(n, "task", "left").groupBy(F.coalesce("k", F.lit(False)).alias("known"), F.col("task").isNotNull().alias("named")).agg(F.count("*").alias("docs"))


@query("j18_candidates_saved", _MOVE + " SELECT count(*) AS tasks, sum(old - new)::BIGINT AS saved, round(avg(old - new), 6) AS avg_saved FROM f WHERE old IS NOT NULL AND new IS NOT NULL")
def j18(spark, sf):
    from quarrymint.operators.ranking import numbered
    from quarrymint.plans.base import sort_order

    o = numbered(outcomes(spark, sf), ["task", "ph"], sort_order(), "pos")
    f = o.groupBy("task").agg(*[F.min(F.when(F.col("passed") & (F.col("ph") == p), F.col("pos"))).alias(n) for p, n in (("baseline", "old"), ("ranked", "new"))]).where("old is not null and new is not null")
    return f.agg(F.count("*").alias("tasks"), F.sum(F.col("old") - F.col("new")).alias("saved"), F.round(F.avg(F.col("old") - F.col("new")), 6).alias("avg_saved"))


_NODE = "concat_ws('|', coalesce(task, '-'), ph, coalesce(plan, '-'), {0}::VARCHAR)"


@query("j19_bounded_walk", f"""WITH RECURSIVE {C}, e AS (SELECT DISTINCT {_NODE.format('rank_index')} AS a, {_NODE.format('r')} AS b FROM (SELECT task, ph, plan, rank_index, unnest(overlapping_candidate_ranks) AS r FROM c) WHERE rank_index IS NOT NULL AND r IS NOT NULL),
w(node, distance) AS (SELECT DISTINCT {_NODE.format('rank_index')}, 0 FROM c WHERE rank_index = 1 UNION SELECT e.b, w.distance + 1 FROM w JOIN e ON e.a = w.node WHERE w.distance < 3) SELECT node, min(distance)::INT AS distance FROM w GROUP BY node""")
def j19(spark, sf):
    """Ranks reached from the first candidate of a plan over the overlap lists, at most three steps."""
    c = outcomes(spark, sf, "overlapping_candidate_ranks")
    node = lambda r: F.concat_ws("|", F.coalesce("task", F.lit("-")), "ph", F.coalesce("plan", F.lit("-")), F.col(r).cast("string"))
    e = c.select(*PLAN, "rank_index", F.explode("overlapping_candidate_ranks").alias("r")).where("rank_index is not null and r is not null").select(node("rank_index").alias("a"), node("r").alias("b")).distinct()
    return bounded_walk(e, c.where("rank_index = 1").select(node("rank_index").alias("node")), 3)


@query("j20_membership", f"WITH {C}, {T}, k AS (SELECT DISTINCT task, task IN (SELECT name FROM t) AS known FROM c), m AS (SELECT task, row_number() OVER (ORDER BY task) AS i FROM k WHERE NOT known) SELECT (SELECT count(*) FROM k WHERE known) AS known, (SELECT count(*) FROM k WHERE NOT known) AS unknown, (SELECT coalesce(string_agg(task, ',' ORDER BY task), '') FROM m WHERE i <= 5) AS first_unknown")
def j20(spark, sf):
    """Tasks of candidates that the manifest knows, those it does not, and the first five of these by name."""
    c, t = outcomes(spark, sf).select("task").distinct(), tasks(spark, sf).select(F.col("name").alias("task")).distinct().withColumn("k", F.lit(True))
    j = cut(c.join(t, "task", "left"), "membership")
    first = j.where(F.col("k").isNull()).orderBy("task").limit(5).agg(F.array_join(F.array_sort(F.collect_list("task")), ",").alias("first_unknown"))
    return j.agg(F.count("k").alias("known"), F.count_if(F.col("k").isNull()).alias("unknown")).join(F.broadcast(first), F.lit(True))


# --- set operations


@query("u02_bench_union", f"WITH {C}, {TR}, m AS (SELECT DISTINCT transition_id FROM mined_git_transitions) SELECT 'candidate' AS kind, count(*) AS rows_ FROM c UNION ALL SELECT 'prompt_repo', count(*) FROM tr UNION ALL SELECT 'git', count(*) FROM m")
def u02(spark, sf):
    parts = [
        outcomes(spark, sf).select(F.lit("candidate").alias("kind"), F.col("candidate_id").cast("string").alias("id")),
        transitions(spark, sf).select(F.lit("prompt_repo").alias("kind"), "id"),
        read(spark, sf, "mined_git_transitions").select("transition_id").distinct().select(F.lit("git").alias("kind"), F.col("transition_id").cast("string").alias("id")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count("*").alias("rows_"))


@query("u03_intersect_except", f"WITH {C}, {T}, i AS (SELECT name FROM t INTERSECT SELECT task FROM c), x AS (SELECT name FROM t EXCEPT SELECT task FROM c) SELECT name, 'both' AS side FROM i UNION ALL SELECT name, 'tasks_only' FROM x")
def u03(spark, sf):
    t, c = tasks(spark, sf).select("name"), outcomes(spark, sf).select(F.col("task").alias("name"))
    return t.intersect(c).withColumn("side", F.lit("both")).unionByName(t.subtract(c).withColumn("side", F.lit("tasks_only")))


@query("u04_miss_sets", f"WITH {C}, g AS (SELECT task, coalesce(bool_or(passed) FILTER (WHERE ph = 'baseline'), false) AS a, coalesce(bool_or(passed) FILTER (WHERE ph = 'ranked'), false) AS b FROM c GROUP BY task) SELECT task, CASE WHEN NOT a AND b THEN 'fixed' WHEN a AND NOT b THEN 'regressed' ELSE 'both' END AS change FROM g WHERE NOT (a AND b)")
def u04(spark, sf):
    g = outcomes(spark, sf).groupBy("task").agg(*[F.coalesce(F.bool_or(F.when(F.col("ph") == p, F.coalesce("passed", F.lit(False)))), F.lit(False)).alias(n) for p, n in (("baseline", "a"), ("ranked", "b"))])
    return g.where(~(F.col("a") & F.col("b"))).select("task", F.when(~F.col("a") & F.col("b"), "fixed").when(F.col("a") & ~F.col("b"), "regressed").otherwise("both").alias("change"))


@query("u05_multiset_difference", "WITH m AS (SELECT DISTINCT transition_id, before_source, after_source FROM mined_git_transitions), l AS (SELECT transition_id, w, sum(s)::BIGINT AS n FROM (SELECT transition_id, unnest(regexp_extract_all(coalesce(after_source, ''), '[A-Za-z_]+')) AS w, 1 AS s FROM m UNION ALL SELECT transition_id, unnest(regexp_extract_all(coalesce(before_source, ''), '[A-Za-z_]+')), -1 FROM m) GROUP BY 1, 2) SELECT transition_id, coalesce(sum(n) FILTER (WHERE n > 0), 0)::BIGINT AS added, coalesce(-sum(n) FILTER (WHERE n < 0), 0)::BIGINT AS removed FROM l GROUP BY 1")
def u05(spark, sf):
    """Words added and removed by a change, as multisets."""
    df = read(spark, sf, "mined_git_transitions").select("transition_id", "before_source", "after_source").dropDuplicates(["transition_id"])
    found = lambda c, s: F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([A-Za-z_]+)"), F.lit(1)), lambda w: F.struct(w.alias("w"), F.lit(s).alias("s")))
    words = df.select("transition_id", F.explode(F.concat(found("after_source", 1), found("before_source", -1))).alias("x")).groupBy("transition_id", "x.w").agg(F.sum("x.s").alias("n"))
    return words.groupBy("transition_id").agg(F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("n"))), F.lit(0)).alias("added"), F.coalesce(-F.sum(F.when(F.col("n") < 0, F.col("n"))), F.lit(0)).alias("removed"))


@query("u06_ordered_distinct", f"WITH {C} SELECT candidate_id, list_filter([0, 1, 2, 3], lambda k: list_contains(overlapping_candidate_ranks, k))::BIGINT[] AS canonical, len(list_distinct(overlapping_candidate_ranks)) + CASE WHEN list_contains(list_transform(overlapping_candidate_ranks, lambda v: v IS NULL), true) THEN 1 ELSE 0 END AS distinct_ranks FROM c WHERE overlapping_candidate_ranks IS NOT NULL")
def u06(spark, sf):
    df = outcomes(spark, sf, "overlapping_candidate_ranks").where("overlapping_candidate_ranks is not null")
    order = F.array(*[F.lit(i).cast("long") for i in range(4)])
    return df.select("candidate_id", F.filter(order, lambda k: F.coalesce(F.array_contains("overlapping_candidate_ranks", k), F.lit(False))).alias("canonical"), F.size(F.array_distinct("overlapping_candidate_ranks")).cast("long").alias("distinct_ranks"))


@query("g02_checks", f"WITH {C}, {_PLANS}, m AS (SELECT count(*) AS n, count(*) FILTER (WHERE passing > 0) / count(*) AS solved, count(*) FILTER (WHERE first_passed) / count(*) AS first FROM plans), k AS (SELECT unnest([{{'name': 'has_plans', 'ok': n > 0}}, {{'name': 'solved_rate', 'ok': solved >= 0.1}}, {{'name': 'pass_at_1_rate', 'ok': first >= 0.5}}]) AS k FROM m) SELECT bool_and(k.ok) AS all_ok, list_sort(list(k.name) FILTER (WHERE NOT k.ok)) AS blockers FROM k")
def g02(spark, sf):
    m = plans(spark, sf).agg(F.count("*").alias("n"), ratio(F.count_if(F.col("passing") > 0), F.count("*"), 12).alias("solved"), ratio(F.count_if("first_passed"), F.count("*"), 12).alias("first"))
    checks = {"has_plans": F.col("n") > 0, "solved_rate": F.col("solved") >= 0.1, "pass_at_1_rate": F.col("first") >= 0.5}
    all_ok = F.lit(True)
    for c in checks.values():
        all_ok = all_ok & F.coalesce(c, F.lit(False))
    return m.select(all_ok.alias("all_ok"), F.array_sort(F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))).alias("blockers"))
