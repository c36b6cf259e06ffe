"""Queries of windows, top-k, quality, retrieval and learners."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from quarrymint.functions.hashing import short_id
from quarrymint.functions.text import normalized, tokens
from quarrymint.operators.splits import group_split
from quarrymint.operators.learners import fit_pairwise, fit_perceptron, linear_score, predict
from quarrymint.operators.ranking import evenly_spaced, evenly_spaced_by, first_label, first_where, round_robin, top_k
from quarrymint.operators.retrieval import encode_text, knn, prototype_score
from quarrymint.plans.base import ORDER, PLAN, TR, C, O, T, group_text, outcomes, register, sort_order, tasks, transitions
from quarrymint.plans.rollup_queries import placed
from quarrymint.session import cut, read, skew_join

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = partial(register, QUERIES, ORACLE)
_S = "CASE WHEN isnan({0}) THEN NULL ELSE {0} END"
_score = lambda c: F.when(~F.isnan(c), F.col(c))


@query("w01_positions", f"WITH {C}, {O} SELECT candidate_id, pos FROM o")
def w01(spark, sf):
    return placed(spark, sf).select("candidate_id", "pos")


@query("w02_w03_first_pass", f"""WITH {C}, {O} SELECT task, ph, plan, min(pos) FILTER (WHERE passed) AS by_position, arg_min(rank_index, pos) FILTER (WHERE passed AND is_first_pass) AS by_flag, min(rank_index) FILTER (WHERE passed) AS by_rank, coalesce(round(1.0 / min(pos) FILTER (WHERE passed), 6), 0) AS reciprocal, coalesce(bool_or(passed AND pos <= 3), false) AS in_top_3 FROM o GROUP BY task, ph, plan""")
def w02(spark, sf):
    """The definitions of the first passing rank side by side."""
    ok = F.coalesce("passed", F.lit(False))
    first = F.min(F.when(ok, F.col("pos")))
    return placed(spark, sf, "is_first_pass").groupBy(*PLAN).agg(
        first.alias("by_position"), first_where(F.col("rank_index"), ok & F.coalesce("is_first_pass", F.lit(False)), F.col("pos")).alias("by_flag"), F.min(F.when(ok, F.col("rank_index"))).alias("by_rank"),
        F.coalesce(F.round(1.0 / first, 6), F.lit(0.0)).alias("reciprocal"), F.coalesce(F.bool_or(ok & (F.col("pos") <= 3)), F.lit(False)).alias("in_top_3"),
    )


@query("w05_margin", f"WITH {C}, s AS (SELECT task, ph, plan, {_S.format('model_score')} AS s, candidate_id FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY task, ph, plan ORDER BY s DESC NULLS LAST, candidate_id) AS k FROM s) SELECT task, ph, plan, round(max(s) FILTER (WHERE k = 1) - max(s) FILTER (WHERE k = 2), 6) AS margin FROM r WHERE k <= 2 GROUP BY 1, 2, 3")
def w05(spark, sf):
    df = outcomes(spark, sf, "model_score").withColumn("s", _score("model_score"))
    two = top_k(df.select(*PLAN, "s", "candidate_id"), PLAN, [F.col("s").desc_nulls_last(), F.col("candidate_id")], 2, "k")
    return two.groupBy(*PLAN).agg(F.round(F.max(F.when(F.col("k") == 1, F.col("s"))) - F.max(F.when(F.col("k") == 2, F.col("s"))), 6).alias("margin"))


@query("w06_first_label", f"WITH {C} SELECT task, arg_min(symbol, (rk, candidate_id)) FILTER (WHERE NOT regexp_full_match(symbol, '\\s*')) AS symbol, arg_min(node_kind, (rk, candidate_id)) FILTER (WHERE NOT regexp_full_match(node_kind, '\\s*')) AS node_kind FROM c GROUP BY task")
def w06(spark, sf):
    return outcomes(spark, sf, "symbol", "node_kind").groupBy("task").agg(first_label("symbol", ORDER()).alias("symbol"), first_label("node_kind", ORDER()).alias("node_kind"))


@query("w07_positive_choice", f"WITH {C} SELECT task, ph, plan, arg_min(candidate_id, (CASE WHEN passed AND preferred THEN 0 WHEN passed AND is_first_pass THEN 1 ELSE 2 END, rk, candidate_id)) FILTER (WHERE passed) AS positive FROM c GROUP BY 1, 2, 3")
def w07(spark, sf):
    ok = F.coalesce("passed", F.lit(False))
    tier = F.when(F.coalesce("preferred", F.lit(False)), 0).when(F.coalesce("is_first_pass", F.lit(False)), 1).otherwise(2)
    return outcomes(spark, sf, "preferred", "is_first_pass").groupBy(*PLAN).agg(first_where(F.col("candidate_id"), ok, F.struct(tier.alias("t"), ORDER().alias("o"))).alias("positive"))


@query("w09_even_sample", f"WITH {T}, o AS (SELECT task_id, row_number() OVER (ORDER BY task_id) - 1 AS i, count(*) OVER () AS n FROM t), p AS (SELECT DISTINCT round_even(x.range * (SELECT any_value(n) - 1 FROM o) / 31.0, 0)::BIGINT AS i FROM range(32) x) SELECT task_id FROM o WHERE n <= 32 OR i IN (SELECT i FROM p)")
def w09(spark, sf):
    return evenly_spaced(tasks(spark, sf).select("task_id"), [F.col("task_id")], 32).select("task_id")


@query("w10_round_robin", "WITH m AS (SELECT DISTINCT transition_id, repo FROM mined_git_transitions), r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY transition_id) AS turn FROM m) SELECT transition_id, repo FROM r WHERE turn <= 20 ORDER BY turn, repo LIMIT 100")
def w10(spark, sf):
    m = read(spark, sf, "mined_git_transitions").select("transition_id", "repo").distinct()
    return round_robin(m, "repo", [F.col("transition_id")], 20, 100).select("transition_id", "repo")


@query("w12_validation_comparison", f"""WITH {C}, s AS (SELECT *, row_number() OVER (PARTITION BY task, ph, plan ORDER BY {_S.format('ranker_score')} DESC NULLS LAST, rk, candidate_id) AS p FROM c), {O}, g AS (SELECT task, ph, plan, min(p) FILTER (WHERE passed) AS scorer, min(p) FILTER (WHERE passed IS NULL) AS unknown FROM s GROUP BY 1, 2, 3), e AS (SELECT task, ph, plan, min(pos) FILTER (WHERE passed) AS existing FROM o GROUP BY 1, 2, 3)
SELECT CASE WHEN unknown IS NOT NULL AND (scorer IS NULL OR unknown < scorer) THEN 'unknown' WHEN scorer IS NULL OR existing IS NULL THEN 'unknown' WHEN scorer < existing THEN 'improved' WHEN scorer > existing THEN 'regressed' ELSE 'same' END AS would_have, count(*) AS plans FROM g JOIN e ON e.task = g.task AND e.ph = g.ph AND e.plan IS NOT DISTINCT FROM g.plan GROUP BY 1""")
def w12(spark, sf):
    from quarrymint.operators.ranking import numbered

    df = outcomes(spark, sf, "ranker_score").withColumn("s", _score("ranker_score"))
    both = numbered(numbered(df, PLAN, sort_order(), "pos"), PLAN, [F.col("s").desc_nulls_last(), *sort_order()], "p")
    least = lambda c, when: F.min(F.when(when, F.col(c)))
    g = both.groupBy(*PLAN).agg(least("p", F.col("passed")).alias("scorer"), least("p", F.col("passed").isNull()).alias("unknown"), least("pos", F.col("passed")).alias("existing"))
    blocked = F.col("unknown").isNotNull() & (F.col("scorer").isNull() | (F.col("unknown") < F.col("scorer")))
    label = F.when(blocked | F.col("scorer").isNull() | F.col("existing").isNull(), "unknown").when(F.col("scorer") < F.col("existing"), "improved").when(F.col("scorer") > F.col("existing"), "regressed").otherwise("same")
    return g.groupBy(label.alias("would_have")).agg(F.count("*").alias("plans"))


@query("w13_w14_competitors", f"WITH {C}, k AS (SELECT task, ph, plan, file_path, symbol, count(*) AS n, bool_or(action = 'rename_symbol') AS has_rename FROM c WHERE symbol IS NOT NULL GROUP BY ALL) SELECT candidate_id, coalesce(n, 0)::BIGINT AS same_symbol, greatest(coalesce(n, 0) - 1, 0)::BIGINT AS competitors, coalesce(has_rename AND c.action <> 'rename_symbol', false) AS rename_sibling FROM c LEFT JOIN k ON k.task = c.task AND k.ph = c.ph AND k.plan IS NOT DISTINCT FROM c.plan AND k.file_path = c.file_path AND k.symbol = c.symbol".replace("GROUP BY ALL", "GROUP BY task, ph, plan, file_path, symbol"))
def w13(spark, sf):
    """Rows of the same plan, file and symbol, by aggregate and join back instead of a window over a hot plan."""
    df = outcomes(spark, sf, "file_path", "symbol", "action")
    k = F.when(F.col("symbol").isNotNull(), group_text(*PLAN, "file_path", "symbol"))
    df = cut(df.select("candidate_id", "action", k.alias("k")), "competitors")
    per = df.where(F.col("k").isNotNull()).groupBy("k").agg(F.count("*").alias("n"), F.bool_or(F.col("action") == "rename_symbol").alias("r"))
    j = skew_join(df, per, ["k"], F.col("candidate_id"), "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    return j.select("candidate_id", n.alias("same_symbol"), F.greatest(n - 1, F.lit(0)).cast("long").alias("competitors"), F.coalesce(F.col("r") & (F.col("action") != "rename_symbol"), F.lit(False)).alias("rename_sibling"))


@query("w15_first_hint", f"WITH {C} SELECT candidate_id, list_filter(failure_hints, lambda h: h.exception_type IS NOT NULL)[1].exception_type AS first_exception FROM c")
def w15(spark, sf):
    first = F.get(F.filter("failure_hints", lambda h: h["exception_type"].isNotNull()), F.lit(0))["exception_type"]
    return outcomes(spark, sf, "failure_hints").select("candidate_id", first.alias("first_exception"))


# --- top-k

_Q = "q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0), e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"


def _vectors(spark, sf):
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def _knn_sql(expr: str, order: str) -> str:
    return f"WITH {_Q}, s AS (SELECT q.vec_id AS query, e.vec_id AS id, round({expr}, 6) + 0.0 AS score FROM q JOIN e ON q.vec_id <> e.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY {order}) AS rank FROM s) SELECT query, id, score, rank::INT AS rank FROM r WHERE rank <= 5"


@query("t01_r04_knn_cosine", _knn_sql("list_cosine_similarity(q.v, e.v)", "score DESC, id"))
def t01(spark, sf):
    p = _vectors(spark, sf)
    return knn(p, p.where(F.col("id") % 20 == 0), 5)


@query("t02_knn_dot_ids_descending", _knn_sql("list_dot_product(q.v, e.v)", "score DESC, id DESC"))
def t02(spark, sf):
    p = _vectors(spark, sf)
    return knn(p, p.where(F.col("id") % 20 == 0), 5, "dot", "desc")


@query("t03_nearest_euclidean", _knn_sql("list_distance(q.v, e.v)", "score, id").replace("rank <= 5", "rank <= 1"))
def t03(spark, sf):
    p = _vectors(spark, sf)
    return knn(p, p.where(F.col("id") % 20 == 0), 1, "euclidean")


_ORDERS = {
    "existing": "rk, candidate_id",
    "model_score": f"{_S.format('model_score')} DESC NULLS LAST, rk, candidate_id",
    "ranker_score": f"{_S.format('ranker_score')} DESC NULLS LAST, rk, candidate_id",
    "lexical": "action, file_path, symbol NULLS LAST, candidate_id",
    "random": "sha256('order:' || candidate_id), candidate_id",
}


@query("t04_strategies_top3", f"WITH {C} " + " UNION ALL ".join(f"SELECT '{s}' AS strategy, candidate_id, row_number() OVER (PARTITION BY task, ph, plan ORDER BY {o}) AS place FROM c QUALIFY place <= 3" for s, o in _ORDERS.items()))
def t04(spark, sf):
    df = outcomes(spark, sf, "model_score", "ranker_score", "action", "file_path", "symbol")
    orders = {
        "existing": sort_order(),
        "model_score": [_score("model_score").desc_nulls_last(), *sort_order()],
        "ranker_score": [_score("ranker_score").desc_nulls_last(), *sort_order()],
        "lexical": [F.asc("action"), F.asc("file_path"), F.col("symbol").asc_nulls_last(), F.asc("candidate_id")],
        "random": [F.sha2(F.concat(F.lit("order:"), F.col("candidate_id").cast("string")), 256), F.asc("candidate_id")],
    }
    out = None
    for s, o in orders.items():
        part = top_k(df, PLAN, o, 3, "place").select(F.lit(s).alias("strategy"), "candidate_id", F.col("place").cast("long").alias("place"))
        out = part if out is None else out.unionByName(part)
    return out


@query("t05_multi_key_default", f"WITH {C}, s AS (SELECT candidate_id, task, coalesce(nullif({_S.format('model_score')}, 0), -1.0) AS s, coalesce({_S.format('failure_hint_score')}, 0) AS h, rk FROM c) SELECT task, candidate_id, place FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY h DESC, s DESC, rk, candidate_id) AS place FROM s) WHERE place <= 2")
def t05(spark, sf):
    """Missing keys count as defaults; a score of 0 counts as missing, as in the order it re-creates."""
    df = outcomes(spark, sf, "model_score", "failure_hint_score")
    s, h = F.coalesce(F.nullif(_score("model_score"), F.lit(0.0)), F.lit(-1.0)), F.coalesce(_score("failure_hint_score"), F.lit(0.0))
    return top_k(df, ["task"], [h.desc(), s.desc(), *sort_order()], 2, "place").select("task", "candidate_id", F.col("place").cast("long").alias("place"))


@query("t06_bounded_examples", f"WITH {C} SELECT action, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY action ORDER BY rk DESC, candidate_id DESC) AS k FROM c WHERE passed IS NOT TRUE) WHERE k <= 5")
def t06(spark, sf):
    df = outcomes(spark, sf, "action").where(~F.coalesce("passed", F.lit(False)))
    return top_k(df, ["action"], [F.col("rank_index").desc_nulls_first(), F.desc("candidate_id")], 5).select("action", "candidate_id")


@query("t07_counts_first_seen", f"WITH {C} SELECT symbol, count(*) AS n, min(candidate_id) AS first_seen FROM c GROUP BY symbol ORDER BY n DESC, first_seen LIMIT 10")
def t07(spark, sf):
    return outcomes(spark, sf, "symbol").groupBy("symbol").agg(F.count("*").alias("n"), F.min("candidate_id").alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(10)


@query("t08_counts_by_value", f"WITH {C} SELECT action, count(*) AS n FROM c GROUP BY action ORDER BY n DESC, action LIMIT 10")
def t08(spark, sf):
    return outcomes(spark, sf, "action").groupBy("action").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "action").limit(10)


@query("t09_search_budget", f"WITH {C}, {O}, f AS (SELECT task, ph, plan, min(pos) FILTER (WHERE passed) AS f FROM o GROUP BY 1, 2, 3) SELECT candidate_id FROM o JOIN f ON o.task = f.task AND o.ph = f.ph AND o.plan IS NOT DISTINCT FROM f.plan WHERE pos <= least(coalesce(f.f + 2, 40), 40)")
def t09(spark, sf):
    """Candidates that a search would have tested: two beyond the first pass, 40 at most."""
    o = placed(spark, sf).where(F.col("pos") <= 40)
    f = o.groupBy(*[F.col(c).alias(f"{c}_") for c in PLAN]).agg(F.min(F.when(F.col("passed"), F.col("pos"))).alias("f"))
    on = F.lit(True)
    for c in PLAN:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}_"))
    return o.join(f, on).where(F.col("pos") <= F.least(F.coalesce(F.col("f") + 2, F.lit(40)), F.lit(40))).select("candidate_id")


@query("t10_choice_groups", f"WITH {C}, {O} SELECT task, ph, plan, list(candidate_id ORDER BY pos) FILTER (WHERE pos <= 10) AS head, count(*) AS candidates, count(*) FILTER (WHERE passed) AS passing FROM o GROUP BY 1, 2, 3")
def t10(spark, sf):
    """Groups with the first ten candidates in order and counts of all: arrays stay bounded whatever the group."""
    df = outcomes(spark, sf)
    head = top_k(df, PLAN, sort_order(), 10, "pos").groupBy(*PLAN).agg(F.array_sort(F.collect_list(F.struct("pos", "candidate_id"))).alias("h"))
    all_ = df.groupBy(*[F.col(c).alias(f"{c}_") for c in PLAN]).agg(F.count("*").alias("candidates"), F.count_if("passed").alias("passing"))
    on = F.lit(True)
    for c in PLAN:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}_"))
    return head.join(all_, on).select(*PLAN, F.col("h.candidate_id").alias("head"), "candidates", "passing")


# --- splits, duplicates, leakage

_SP = "CASE WHEN lower(trim(split)) IN ('validation', 'val', 'dev') THEN 'validation' WHEN lower(trim(split)) IN ('train', 'test') THEN lower(trim(split)) END"
_sp = lambda: F.when(F.lower(F.trim("split")).isin("validation", "val", "dev"), "validation").when(F.lower(F.trim("split")).isin("train", "test"), F.lower(F.trim("split")))
_NORM = "trim(regexp_replace(lower(prompt), '\\s+', ' ', 'g'))"


@query("d02_group_split", f"WITH {C}, g AS (SELECT DISTINCT task_family AS k FROM c WHERE task_family IS NOT NULL), f AS (SELECT k, ('0x' || substr(sha256('v2:' || k), 1, 16))::UBIGINT::DOUBLE / 18446744073709551615.0 < 0.25 AS v FROM g), s AS (SELECT count(*) AS n, count(*) FILTER (WHERE v) AS m, min(k) AS lo, max(k) AS hi FROM f), r AS (SELECT k, n, CASE WHEN m = 0 THEN k = lo WHEN m = n AND n > 1 THEN k <> hi ELSE v END AS v FROM f CROSS JOIN s) SELECT k AS key, v AS validation, NOT v OR n = 1 AS train, n > 1 AS held_out FROM r")
def d02(spark, sf):
    """Task families split by hash, neither side empty."""
    return group_split(outcomes(spark, sf, "task_family").select(F.col("task_family").alias("key")), "v2", 0.25)


@query("d03_ordered_split", f"WITH {C}, g AS (SELECT DISTINCT task FROM c), r AS (SELECT task, row_number() OVER (ORDER BY task) AS i, count(*) OVER () AS n FROM g) SELECT task, i > n - round_even(n * 0.25, 0) AS validation FROM r")
def d03(spark, sf):
    from quarrymint.operators.ranking import numbered

    g = outcomes(spark, sf).select("task").distinct().withColumn("one", F.lit(1))
    n = g.count()
    return numbered(g, ["one"], [F.col("task")], "i").select("task", (F.col("i") > n - round(n * 0.25)).alias("validation"))


@query("d04_exact_duplicates", f"WITH {T}, n AS (SELECT {_NORM} AS norm, {_SP} AS sp, task_id FROM t WHERE prompt IS NOT NULL AND trim(prompt) <> '') SELECT norm, count(*) AS n, count(DISTINCT sp) AS splits, min(task_id) AS first_task FROM n GROUP BY norm HAVING count(*) > 1")
def d04(spark, sf):
    df = tasks(spark, sf).where(F.col("prompt").isNotNull() & (F.trim("prompt") != "")).select("task_id", normalized(F.col("prompt")).alias("norm"), _sp().alias("sp"))
    flags = [F.max(F.when(F.col("sp") == s, 1).otherwise(0)) for s in ("train", "validation", "test")]
    return df.groupBy("norm").agg(F.count("*").alias("n"), (flags[0] + flags[1] + flags[2]).cast("long").alias("splits"), F.min("task_id").alias("first_task")).where(F.col("n") > 1)


@query("d05_family_leakage", f"WITH {T}, n AS (SELECT family, {_SP} AS sp FROM t WHERE family IS NOT NULL AND trim(family) <> '') SELECT family, count(*) AS n, count(DISTINCT sp) AS splits FROM n GROUP BY family HAVING count(DISTINCT sp) > 1")
def d05(spark, sf):
    df = tasks(spark, sf).where(F.col("family").isNotNull() & (F.trim("family") != "")).withColumn("sp", _sp())
    flags = [F.max(F.when(F.col("sp") == s, 1).otherwise(0)) for s in ("train", "validation", "test")]
    return df.groupBy("family").agg(F.count("*").alias("n"), (flags[0] + flags[1] + flags[2]).cast("long").alias("splits")).where(F.col("splits") > 1)


@query("d07_signature_dedup", f"WITH {C} SELECT action, count(DISTINCT concat_ws('|', file_path, symbol, start_line::VARCHAR, end_line::VARCHAR)) AS signatures, count(*) AS rows_ FROM c GROUP BY action")
def d07(spark, sf):
    sig = F.concat_ws("|", "file_path", "symbol", F.col("start_line").cast("string"), F.col("end_line").cast("string"))
    per = outcomes(spark, sf, "action", "file_path", "symbol", "start_line", "end_line").groupBy("action", sig.alias("s")).agg(F.count("*").alias("k"))
    return per.groupBy("action").agg(F.count("*").alias("signatures"), F.sum("k").alias("rows_"))


@query("d08_schema_variants", "WITH l AS (SELECT DISTINCT line_id, line FROM outcome_log WHERE json_valid(line) AND json_type(line::JSON) = 'OBJECT') SELECT array_to_string(list_sort(list_distinct(json_keys(line::JSON))), ',') AS keys, count(*) AS n FROM l GROUP BY 1")
def d08(spark, sf):
    df = read(spark, sf, "outcome_log").select("line_id", "line").dropDuplicates(["line_id"])
    keys = F.json_object_keys("line")
    ok = F.try_parse_json("line").isNotNull() & F.trim("line").startswith("{")
    return df.where(ok).groupBy(F.array_join(F.array_sort(F.array_distinct(keys)), ",").alias("keys")).agg(F.count("*").alias("n"))


@query("d09_plan_identity", f"WITH {C} SELECT candidate_id, coalesce(plan, 'fallback:' || substr(sha256(concat_ws(chr(31), coalesce('s' || task, 'n'), coalesce('s' || ph, 'n'), coalesce('s' || split, 'n'))), 1, 16)) AS identity, CASE WHEN plan IS NULL THEN 'fallback' ELSE 'explicit' END AS source FROM c")
def d09(spark, sf):
    df = outcomes(spark, sf, "split")
    fallback = F.concat(F.lit("fallback:"), short_id(F.col("task"), F.col("ph"), F.col("split")))
    return df.select("candidate_id", F.coalesce("plan", fallback).alias("identity"), F.when(F.col("plan").isNull(), "fallback").otherwise("explicit").alias("source"))


@query("d10_leakage_keys", f"WITH {T}, k AS (SELECT 'repo' AS field, repo AS value, {_SP} AS sp FROM t UNION ALL SELECT 'name', name, {_SP} FROM t), g AS (SELECT field, value, count(DISTINCT sp) AS s FROM k WHERE value IS NOT NULL GROUP BY 1, 2) SELECT field, count(*) AS values_, count(*) FILTER (WHERE s > 1) AS leaking FROM g GROUP BY field")
def d10(spark, sf):
    df = tasks(spark, sf).withColumn("sp", _sp())
    long = df.select("sp", F.explode(F.array(F.struct(F.lit("repo").alias("field"), F.col("repo").alias("value")), F.struct(F.lit("name").alias("field"), F.col("name").alias("value")))).alias("x")).select("sp", "x.*").where(F.col("value").isNotNull())
    flags = [F.max(F.when(F.col("sp") == s, 1).otherwise(0)) for s in ("train", "validation", "test")]
    return long.groupBy("field", "value").agg((flags[0] + flags[1] + flags[2]).alias("s")).groupBy("field").agg(F.count("*").alias("values_"), F.count_if(F.col("s") > 1).alias("leaking"))


# --- retrieval and learners


@query("r01_text_vectors")
def r01(spark, sf):
    """Nearest other prompts of every 20th task by hashed text vectors."""
    v = encode_text(tasks(spark, sf).select("task_id", "prompt"), "task_id", tokens(F.col("prompt")), 64).select(F.col("task_id").alias("id"), "v")
    return knn(v, v.where(F.col("id") % 20 == 0), 3)


@query("r07_a14_retrieval_accuracy", f"WITH {_Q}, s AS (SELECT q.vec_id AS query, e.vec_id AS id, round(list_cosine_similarity(q.v, e.v), 6) + 0.0 AS score FROM q JOIN e ON q.vec_id <> e.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS k FROM s), h AS (SELECT query, max((a.label = b.label AND k = 1)::INT) AS h1, max((a.label = b.label)::INT) AS h5 FROM r JOIN embeddings a ON a.vec_id = query JOIN embeddings b ON b.vec_id = id WHERE k <= 5 GROUP BY query) SELECT count(*) AS queries, sum(h1)::BIGINT AS top_1, sum(h5)::BIGINT AS top_5 FROM h")
def r07(spark, sf):
    p = _vectors(spark, sf)
    near = knn(p, p.where(F.col("id") % 20 == 0), 5)
    e = read(spark, sf, "embeddings")
    j = near.join(e.select(F.col("vec_id").alias("query"), F.col("label").alias("a")), "query").join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("b")), "id")
    hit = (F.col("a") == F.col("b")).cast("int")
    per = j.groupBy("query").agg(F.max(F.when(F.col("rank") == 1, hit).otherwise(0)).alias("h1"), F.max(hit).alias("h5"))
    return per.agg(F.count("*").alias("queries"), F.sum("h1").alias("top_1"), F.sum("h5").alias("top_5"))


@query("r10_prototype_scores", "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT label, list(x ORDER BY i) AS p FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e) GROUP BY 1, 2) GROUP BY label) SELECT vec_id, round(list_cosine_similarity(v, p), 6) AS score FROM e JOIN m USING (label)")
def r10(spark, sf):
    from quarrymint.functions.vec import cosine

    e = read(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    m = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("a")).select("label", F.col("a.x").alias("p"))  # as long as a vector
    score = prototype_score([(0.5, cosine(F.col("v"), F.col("p"))), (0.3, F.lit(None).cast("double"))])
    return e.join(m, "label").select("vec_id", score.alias("score"))


#: Most exemplars of a label; the label that stands for git transitions, which have no vectors in the test tables.
EXEMPLARS, GIT_LABEL = 256, 0


@query("r10_exemplar_scores", f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT label, list(x ORDER BY i) AS p FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e) GROUP BY 1, 2) GROUP BY label),
o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place, count(*) OVER (PARTITION BY label) AS n FROM e), k AS (SELECT label, v FROM o WHERE n <= {EXEMPLARS} OR list_contains(list_transform(range({EXEMPLARS}), lambda i: round_even(i * ((n - 1) / {EXEMPLARS - 1}.0::DOUBLE), 0)::BIGINT), place)),
a AS (SELECT vec_id, max(list_cosine_similarity(e.v, k.v)) AS s FROM e JOIN k USING (label) GROUP BY 1), g AS (SELECT vec_id, max(list_cosine_similarity(e.v, k.v)) AS s FROM e JOIN k ON k.label = {GIT_LABEL} GROUP BY 1)
SELECT e.vec_id, round((0.5 * list_cosine_similarity(v, p) + 0.3 * a.s + 0.2 * coalesce(g.s, 0)) / (CASE WHEN g.s IS NULL THEN 0.8 ELSE 1.0 END), 6) AS score FROM e JOIN m USING (label) JOIN a USING (vec_id) LEFT JOIN g USING (vec_id)""")
def r10_exemplars(spark, sf):
    """R10 in full: the mean of the label, the nearest of its exemplars, and the nearest of the exemplars of GIT_LABEL."""
    from quarrymint.functions.vec import cosine

    e = read(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    m = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("a")).select("label", F.col("a.x").alias("p"))  # as long as a vector
    some = evenly_spaced_by(e, "label", [F.col("vec_id")], EXEMPLARS).select("label", "v")
    lists = some.groupBy("label").agg(F.collect_list("v").alias("own"))  # at most EXEMPLARS vectors
    git = lists.where(F.col("label") == GIT_LABEL).select(F.col("own").alias("git"))
    near = lambda c: F.array_max(F.transform(c, lambda x: cosine(F.col("v"), x)))
    score = prototype_score([(0.5, cosine(F.col("v"), F.col("p"))), (0.3, near("own")), (0.2, near("git"))])
    return e.join(m, "label").join(lists, "label").join(F.broadcast(git), F.lit(True), "left").select("vec_id", score.alias("score"))


@query("r11_exact_lookup", f"WITH {T}, n AS (SELECT {_NORM} AS norm, family, task_id FROM t WHERE prompt IS NOT NULL), f AS (SELECT norm, arg_min(coalesce(family, '-'), task_id) AS label FROM n GROUP BY norm) SELECT n.task_id, f.label, 1.0::DOUBLE AS confidence FROM n JOIN f USING (norm)")
def r11(spark, sf):
    n = tasks(spark, sf).where(F.col("prompt").isNotNull()).select("task_id", normalized(F.col("prompt")).alias("norm"), "family")
    f = n.groupBy("norm").agg(F.min_by(F.coalesce("family", F.lit("-")), "task_id").alias("label"))
    return n.join(f, "norm").select("task_id", "label", F.lit(1.0).alias("confidence"))


_DELTA = f"""{TR}, d AS (SELECT id, structured_action.kind AS action, repo_before.state.repo_embedding AS a, repo_after.state.repo_embedding AS b FROM tr), ok AS (SELECT * FROM d WHERE a IS NOT NULL AND b IS NOT NULL AND len(a) = len(b) AND len(a) > 0)"""


@query("m01_m02_action_deltas", f"WITH {_DELTA}, l AS (SELECT action, len(a) AS dim, generate_subscripts(a, 1) - 1 AS i, unnest(list_transform(list_zip(a, b), lambda x: x[2] - x[1])) AS x FROM ok) SELECT action, dim::INT AS dim, i::INT AS i, round(round(sum(x), 6) / count(x), 6) AS mean, count(x) AS n FROM l GROUP BY 1, 2, 3")
def m02(spark, sf):
    """Mean change of the repository vector by action, element by element."""
    from quarrymint.functions.vec import subtract

    a, b = F.col("repo_before.state.repo_embedding"), F.col("repo_after.state.repo_embedding")
    d = transitions(spark, sf).where((F.size(a) == F.size(b)) & (F.size(a) > 0)).select(F.col("structured_action.kind").alias("action"), F.size(a).alias("dim"), F.posexplode(subtract(b, a)).alias("i", "x"))
    # the sum is rounded first: the order in which it was taken cannot tip a mean that lies between two last digits
    return d.groupBy("action", "dim", "i").agg(F.round(F.round(F.sum("x"), 6) / F.count("x"), 6).alias("mean"), F.count("x").alias("n"))


_F = f"s AS (SELECT candidate_id, task, ph, plan, passed, coalesce({_S.format('model_score')}, 0) AS f0, coalesce({_S.format('failure_hint_score')}, 0) AS f1, coalesce(diff_added_lines, 0) AS f2 FROM c)"


def _features(spark, sf):
    df = outcomes(spark, sf, "model_score", "failure_hint_score", "diff_added_lines")
    return df.select("candidate_id", *PLAN, "passed", "rank_index", F.coalesce(_score("model_score"), F.lit(0.0)).alias("f0"), F.coalesce(_score("failure_hint_score"), F.lit(0.0)).alias("f1"), F.coalesce(F.col("diff_added_lines").cast("double"), F.lit(0.0)).alias("f2"))


@query("m09_m10_linear_score", f"WITH {C}, {_F} SELECT candidate_id, round(2.0 * f0 + 0.05 * f1 - 0.1 * f2 + 0.5, 6) AS score FROM s")
def m09(spark, sf):
    long = _features(spark, sf).select("candidate_id", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in ("f0", "f1", "f2")])).alias("x")).select("candidate_id", "x.*")
    return linear_score(long, "candidate_id", {"f0": 2.0, "f1": 0.05, "f2": -0.1}, 0.5)


@query("m07_pairwise_ranker")
def m07(spark, sf):
    """Weights of a margin ranker fitted to (first passing, first failing) pairs of each plan."""
    f = _features(spark, sf)
    ok = F.coalesce("passed", F.lit(False))
    x = F.array("f0", "f1", "f2")
    g = f.groupBy(*PLAN).agg(F.min_by(F.when(ok, x), F.when(ok, ORDER())).alias("p"), F.min_by(F.when(~ok, x), F.when(~ok, ORDER())).alias("q"), F.min("candidate_id").alias("key")).where("p is not null and q is not null")
    weights = fit_pairwise(g.select("key", F.zip_with("p", "q", lambda a, b: a - b).alias("diff")), "key", ["f0", "f1", "f2"])
    return spark.createDataFrame(sorted(weights.items()), "name string, weight double")


@query("m14_token_perceptron")
def m14(spark, sf):
    """Source types of tasks predicted from prompt tokens: confusion of expected and predicted."""
    t = tasks(spark, sf).where("prompt is not null and source_type is not null")
    train = t.where(F.lower(F.trim("split")) == "train")
    w = fit_perceptron(train, "task_id", tokens(F.col("prompt")), F.col("source_type"))
    p = predict(w, t.where(_sp() == "test"), "task_id", tokens(F.col("prompt")))
    return p.join(t.select("task_id", "source_type"), "task_id").groupBy(F.col("source_type").alias("expected"), "predicted").agg(F.count("*").alias("n"))
