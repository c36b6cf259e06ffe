"""Queries of the scalar functions, projections, filters and validators."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from quarrymint.functions.hashing import percent64, percent256, short_id, signed_bucket, stable_fraction, stable_split
from quarrymint.functions.text import bucket, char_ngrams, diff_counts, jaccard, ngrams, normalized, tokens
from quarrymint.functions.vec import cosine, dot, euclidean, mean_abs_delta, norm, normalize
from quarrymint.plans.base import TR, C, T, outcomes, register, tasks, transitions
from quarrymint.session import read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = partial(register, QUERIES, ORACLE)

_TOK = "regexp_extract_all(lower(prompt), '(\\*\\*|\\^|[a-z0-9_]+)')"


@query("x01_normalized_prompts", f"WITH {T} SELECT task_id, trim(regexp_replace(lower(prompt), '\\s+', ' ', 'g')) AS norm FROM t")
def x01(spark, sf):
    return tasks(spark, sf).select("task_id", normalized(F.col("prompt")).alias("norm"))


@query("x02_token_counts", f"WITH {T}, w AS (SELECT unnest({_TOK}) AS token FROM t) SELECT token, count(*) AS n FROM w GROUP BY token")
def x02(spark, sf):
    return tasks(spark, sf).select(F.explode(tokens(F.col("prompt"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("x03_bigrams", f"WITH {T}, w AS (SELECT {_TOK} AS w FROM t), b AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM w) SELECT gram, count(*) AS n FROM b GROUP BY gram")
def x03(spark, sf):
    return tasks(spark, sf).select(F.explode(ngrams(tokens(F.col("prompt")), 2)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("x03_skip_bigrams", f"WITH {T}, w AS (SELECT {_TOK} AS w FROM t), b AS (SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 2])) AS gram FROM w) SELECT gram, count(*) AS n FROM b GROUP BY gram")
def x03_skip(spark, sf):
    return tasks(spark, sf).select(F.explode(ngrams(tokens(F.col("prompt")), 2, 2)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("x03_char_trigrams", f"WITH {T}, b AS (SELECT unnest(list_transform(range(1, length(name) + 1), lambda i: substr(' ' || name || ' ', i, 3))) AS gram FROM t) SELECT gram, count(*) AS n FROM b GROUP BY gram")
def x03_chars(spark, sf):
    return tasks(spark, sf).select(F.explode(char_ngrams(F.col("name"), 3)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("x07_x08_signed_hash", f"WITH {T}, w AS (SELECT task_id, unnest({_TOK}) AS token FROM t), h AS (SELECT task_id, ('0x' || substr(sha256(token), 1, 16))::UBIGINT % 64 AS b, CASE WHEN ('0x' || substr(sha256(token), 17, 2))::INT % 2 = 0 THEN 1.0 ELSE -1.0 END AS s FROM w) SELECT task_id, b::INT AS bucket, sum(s)::DOUBLE AS value FROM h GROUP BY 1, 2")
def x08(spark, sf):
    """Feature hashing in long form: (row, bucket, signed count)."""
    b, s = signed_bucket(F.col("token"), 64)
    words = tasks(spark, sf).select("task_id", F.explode(tokens(F.col("prompt"))).alias("token"))
    return words.select("task_id", b.alias("bucket"), s.alias("s")).groupBy("task_id", "bucket").agg(F.sum("s").alias("value"))


_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


@query("x09_normalized_vectors", f"WITH {_E} SELECT vec_id, round(list_aggregate(list_transform(v, lambda x: x * x), 'sum'), 5) AS squared, round(sqrt(list_aggregate(list_transform(v, lambda x: x * x / list_aggregate(list_transform(v, lambda y: y * y), 'sum')), 'sum')), 6) AS unit FROM e")
def x09(spark, sf):
    df = read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return df.select("vec_id", F.round(norm(F.col("v")) * norm(F.col("v")), 5).alias("squared"), F.round(norm(normalize(F.col("v"))), 6).alias("unit"))


@query("x10_vector_pairs", f"WITH {_E} SELECT a.vec_id, round(list_dot_product(a.v, b.v), 6) AS dot, round(list_cosine_similarity(a.v, b.v), 6) AS cosine, round(list_distance(a.v, b.v), 6) AS euclidean, round(list_aggregate(list_transform(list_zip(a.v, b.v), lambda x: abs(x[1] - x[2])), 'avg'), 6) AS mean_abs FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def x10(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    v, w = F.col("v"), F.col("w")
    return e.join(n, "vec_id").select("vec_id", F.round(dot(v, w), 6).alias("dot"), F.round(cosine(v, w), 6).alias("cosine"), F.round(euclidean(v, w), 6).alias("euclidean"), F.round(mean_abs_delta(v, w), 6).alias("mean_abs"))


@query("x12_buckets", f"WITH {C} SELECT CASE WHEN diff_added_lines IS NULL THEN NULL WHEN diff_added_lines <= 0 THEN '0' WHEN diff_added_lines = 1 THEN '1' WHEN diff_added_lines <= 3 THEN '2_3' WHEN diff_added_lines <= 7 THEN '4_7' ELSE '8_plus' END AS added, count(*) AS n FROM c GROUP BY 1")
def x12(spark, sf):
    return outcomes(spark, sf, "diff_added_lines").groupBy(bucket(F.col("diff_added_lines")).alias("added")).agg(F.count("*").alias("n"))


@query("x13_content_ids", f"WITH {T} SELECT task_id, substr(sha256(concat_ws(chr(31), coalesce('s' || name, 'n'), coalesce('s' || repo, 'n'), coalesce('s' || test, 'n'))), 1, 16) AS content_id FROM t")
def x13(spark, sf):
    return tasks(spark, sf).select("task_id", short_id(F.col("name"), F.col("repo"), F.col("test")).alias("content_id"))


_P64 = "(('0x' || substr(sha256(name), 1, 16))::UBIGINT % 100)::BIGINT"
_SPLIT = "CASE WHEN {0} < 80 THEN 'train' WHEN {0} < 90 THEN 'validation' ELSE 'test' END"


@query("x14_stable_split", f"WITH {T}, p AS (SELECT task_id, {_P64} AS percent FROM t) SELECT task_id, percent, {_SPLIT.format('percent')} AS split FROM p")
def x14(spark, sf):
    df = tasks(spark, sf).select("task_id", percent64(F.col("name")).alias("percent"))
    return df.withColumn("split", stable_split(F.col("percent")))


@query("x15_stable_split_256", f"WITH {T} SELECT task_id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(sha256(name), ''), lambda d: ('0x' || d)::BIGINT)), lambda a, d: (a * 16 + d) % 100) AS percent FROM t")
def x15(spark, sf):
    return tasks(spark, sf).select("task_id", percent256(F.col("name")).alias("percent"))


@query("x16_stable_fraction", f"WITH {T} SELECT task_id, round(('0x' || substr(sha256(name), 1, 16))::UBIGINT::DOUBLE / 18446744073709551615.0, 6) AS fraction FROM t")
def x16(spark, sf):
    return tasks(spark, sf).select("task_id", F.round(stable_fraction(F.col("name")), 6).alias("fraction"))


@query("x18_prompt_name_overlap", f"WITH {T} SELECT task_id, round(len(list_intersect(list_distinct({_TOK}), list_distinct(string_split(name, '_')))) / nullif(len(list_distinct(list_concat({_TOK}, string_split(name, '_')))), 0), 6) AS jaccard FROM t WHERE prompt IS NOT NULL")
def x18(spark, sf):
    df = tasks(spark, sf).where(F.col("prompt").isNotNull())
    return df.select("task_id", jaccard(F.array_distinct(tokens(F.col("prompt"))), F.array_distinct(F.split("name", "_"))).alias("jaccard"))


_DIFF = "len(list_filter(string_split(diff, chr(10)), lambda x: starts_with(x, '{0}') AND NOT starts_with(x, '{0}{0}{0}')))"


@query("x23_diff_counts", f"WITH m AS (SELECT DISTINCT transition_id, diff, before_source FROM mined_git_transitions) SELECT transition_id, {_DIFF.format('+')}::INT AS added, {_DIFF.format('-')}::INT AS removed, octet_length(encode(before_source))::INT AS before_bytes, sha256(before_source) AS before_sha FROM m")
def x23(spark, sf):
    added, removed = diff_counts(F.col("diff"))
    df = read(spark, sf, "mined_git_transitions").dropDuplicates(["transition_id"])
    return df.select("transition_id", added.alias("added"), removed.alias("removed"), F.octet_length("before_source").alias("before_bytes"), F.sha2("before_source", 256).alias("before_sha"))


@query("x24_score_value", f"WITH {C}, s AS (SELECT candidate_id, CASE WHEN isnan(model_score) THEN NULL ELSE model_score END AS s FROM c) SELECT candidate_id, round(CASE WHEN abs(s) > 1 THEN s / 100 ELSE s END, 6) AS score FROM s")
def x24(spark, sf):
    s = F.when(~F.isnan("model_score"), F.col("model_score"))
    return outcomes(spark, sf, "model_score").select("candidate_id", F.round(F.when(F.abs(s) > 1, s / 100).otherwise(s), 6).alias("score"))


@query("x25_json_getters", f"WITH {C} SELECT candidate_id, CASE WHEN json_valid(target_context) THEN target_context ->> '$.function_name' END AS function_name, CASE WHEN json_valid(target_context) THEN try_cast(target_context ->> '$.line_span[0]' AS BIGINT) END AS first_line FROM c")
def x25(spark, sf):
    v = F.try_parse_json("target_context")
    return outcomes(spark, sf, "target_context").select("candidate_id", F.try_variant_get(v, "$.function_name", "string").alias("function_name"), F.try_variant_get(v, "$.line_span[0]", "long").alias("first_line"))


WORDS = {"mentions_missing": "missing", "mentions_guard": "guard", "mentions_default": "default", "mentions_last": "last"}


@query("x26_word_rules", f"WITH {T} SELECT task_id, " + ", ".join(f"coalesce(regexp_matches(lower(prompt), '\\b{w}\\b'), false) AS {n}" for n, w in WORDS.items()) + " FROM t")
def x26(spark, sf):
    return tasks(spark, sf).select("task_id", *[F.coalesce(F.lower("prompt").rlike(rf"\b{w}\b"), F.lit(False)).alias(n) for n, w in WORDS.items()])


_HINT = "list_distinct(flatten(list_transform(list_filter(coalesce(failure_hints, []), lambda h: h IS NOT NULL), lambda h: coalesce(h.{0}, []))))"


def hint_values(field: str):
    """Distinct values of a list field over the hints of a row."""
    lists = F.transform(F.filter("failure_hints", lambda h: h.isNotNull()), lambda h: F.coalesce(h[field], F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(lists))


@query("x27_x33_hint_flags", f"""WITH {C}, s AS (SELECT candidate_id, file_path, symbol, params, {_HINT.format('source_files')} AS files, {_HINT.format('function_names')} AS fns, {_HINT.format('missing_names')} AS names, {_HINT.format('missing_keys')} AS keys FROM c WHERE failure_hints IS NOT NULL)
SELECT candidate_id, coalesce(list_contains(files, string_split(file_path, '/')[-1]) OR list_contains(files, file_path), false) AS file_hit, coalesce(list_contains(fns, symbol), false) AS function_hit, coalesce(len(names) > 0, false) AS has_missing_names, coalesce(len(keys) > 0, false) AS has_missing_keys FROM s""")
def x27(spark, sf):
    df = outcomes(spark, sf, "failure_hints", "file_path", "symbol").where(F.col("failure_hints").isNotNull())
    df = df.select("candidate_id", "file_path", "symbol", hint_values("source_files").alias("files"), hint_values("function_names").alias("fns"), hint_values("missing_names").alias("names"), hint_values("missing_keys").alias("keys"))
    base = F.element_at(F.split("file_path", "/"), -1)
    yes = lambda c: F.coalesce(c, F.lit(False))
    return df.select("candidate_id", yes(F.array_contains("files", base) | F.array_contains("files", F.col("file_path"))).alias("file_hit"), yes(F.array_contains("fns", F.col("symbol"))).alias("function_hit"), (F.size("names") > 0).alias("has_missing_names"), (F.size("keys") > 0).alias("has_missing_keys"))


@query("x34_upstream_score", f"WITH {C} SELECT candidate_id, greatest(30 - 8 * (coalesce(rank_index, 99) - 1), 10)::BIGINT AS score FROM c")
def x34(spark, sf):
    return outcomes(spark, sf).select("candidate_id", F.greatest(30 - 8 * (F.coalesce("rank_index", F.lit(99)) - 1), F.lit(10)).cast("long").alias("score"))


@query("proj02_git_bench_rows", "WITH m AS (SELECT DISTINCT transition_id, repo, commit, file_path, before_source, after_source FROM mined_git_transitions) SELECT transition_id, repo || '@' || commit AS identity, octet_length(encode(before_source)) AS before_bytes, octet_length(encode(after_source)) AS after_bytes, sha256(after_source) AS after_sha FROM m WHERE before_source IS NOT NULL AND after_source IS NOT NULL AND NOT regexp_full_match(before_source, '\\s*') AND NOT regexp_full_match(after_source, '\\s*')")
def p02(spark, sf):
    df = read(spark, sf, "mined_git_transitions").where("before_source is not null and after_source is not null").where(F.col("before_source").rlike(r"\S") & F.col("after_source").rlike(r"\S")).dropDuplicates(["transition_id"])
    return df.select("transition_id", F.concat("repo", F.lit("@"), "commit").alias("identity"), F.octet_length("before_source").cast("long").alias("before_bytes"), F.octet_length("after_source").cast("long").alias("after_bytes"), F.sha2("after_source", 256).alias("after_sha"))


@query("proj03_candidate_bench_rows", f"WITH {C} SELECT candidate_id, task || '/' || ph || '/' || coalesce(plan, '-') || '/' || coalesce(rank_index::VARCHAR, '-') AS identity, CASE WHEN passed THEN 'passed' ELSE 'failed' END AS status, action, passed IS NOT NULL AS available FROM c")
def p03(spark, sf):
    df = outcomes(spark, sf, "action")
    ident = F.concat("task", F.lit("/"), "ph", F.lit("/"), F.coalesce("plan", F.lit("-")), F.lit("/"), F.coalesce(F.col("rank_index").cast("string"), F.lit("-")))
    return df.select("candidate_id", ident.alias("identity"), F.when(F.col("passed"), "passed").otherwise("failed").alias("status"), "action", F.col("passed").isNotNull().alias("available"))


@query("proj04_skipped_rows", "WITH m AS (SELECT DISTINCT transition_id, before_source, after_source FROM mined_git_transitions), r AS (SELECT CASE WHEN b AND a THEN 'empty_before_source_after_source' WHEN b THEN 'empty_before_source' WHEN a THEN 'empty_after_source' ELSE 'kept' END AS reason FROM (SELECT coalesce(regexp_full_match(before_source, '\\s*'), true) AS b, coalesce(regexp_full_match(after_source, '\\s*'), true) AS a FROM m)) SELECT reason, count(*) AS n FROM r GROUP BY reason")
def p04(spark, sf):
    df = read(spark, sf, "mined_git_transitions").select("transition_id", *[(~F.coalesce(F.col(f"{s}_source").rlike(r"\S"), F.lit(False))).alias(s) for s in ("before", "after")]).dropDuplicates(["transition_id"])
    missing = F.concat_ws("_", *[F.when(F.col(s), f"{s}_source") for s in ("before", "after")])
    return df.groupBy(F.when(missing == "", "kept").otherwise(F.concat(F.lit("empty_"), missing)).alias("reason")).agg(F.count("*").alias("n"))


@query("proj05_outcome_records", f"WITH {TR} SELECT id, prompt_context.prompt AS prompt, structured_action.kind AS action, CASE WHEN outcome IS NULL THEN 'unknown' WHEN outcome.passed THEN 'passed' WHEN outcome.status = 'blocked' THEN 'blocked' ELSE 'failed' END AS label FROM tr")
def p05(spark, sf):
    o = F.col("outcome")
    label = F.when(o.isNull(), "unknown").when(o["passed"], "passed").when(o["status"] == "blocked", "blocked").otherwise("failed")
    return transitions(spark, sf).select("id", F.col("prompt_context.prompt").alias("prompt"), F.col("structured_action.kind").alias("action"), label.alias("label"))


@query("proj10_edit_metadata", f"WITH {C} SELECT candidate_id, diff_added_lines + diff_removed_lines AS changed, diff_added_lines - diff_removed_lines AS delta, end_line - start_line + 1 AS span, least(abs(start_line - 1), abs(end_line - 1)) AS distance FROM c")
def p10(spark, sf):
    df = outcomes(spark, sf, "diff_added_lines", "diff_removed_lines", "start_line", "end_line")
    return df.select("candidate_id", F.expr("diff_added_lines + diff_removed_lines").alias("changed"), F.expr("diff_added_lines - diff_removed_lines").alias("delta"), F.expr("end_line - start_line + 1").alias("span"), F.expr("least(abs(start_line - 1), abs(end_line - 1))").alias("distance"))


@query("proj12_log_failures", r"""WITH l AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^\s*(\S+::\S+) FAILED', 1)) AS nodeid FROM documents) SELECT nodeid, count(*) AS n, count(DISTINCT doc_id) AS docs FROM l GROUP BY nodeid""")
def p12(spark, sf):
    """Failed tests named in log texts, by line patterns."""
    hits = read(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^\s*(\S+::\S+) FAILED"), F.lit(1))).alias("nodeid"))
    per = hits.groupBy("nodeid", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("nodeid").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@query("proj12_exception_lines", r"""WITH l AS (SELECT unnest(regexp_extract_all(text, '(?m)^E\s+(\w+(?:Error|Exception)):', 1)) AS exception FROM documents) SELECT exception, count(*) AS n FROM l GROUP BY exception""")
def p12_exceptions(spark, sf):
    return read(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^E\s+(\w+(?:Error|Exception)):"), F.lit(1))).alias("exception")).groupBy("exception").agg(F.count("*").alias("n"))


@query("f02_phase_filter", f"WITH {C} SELECT ph AS phase, count(*) AS n FROM c GROUP BY ph")
def f02(spark, sf):
    return outcomes(spark, sf).groupBy(F.col("ph").alias("phase")).agg(F.count("*").alias("n"))


@query("f03_holdout_filter", f"WITH {C}, {T}, h AS (SELECT DISTINCT name FROM t WHERE lower(trim(split)) = 'test') SELECT c.task IN (SELECT name FROM h) AS held_out, count(*) AS n FROM c GROUP BY 1")
def f03(spark, sf):
    held = tasks(spark, sf).where(F.lower(F.trim("split")) == "test").select(F.col("name").alias("task")).distinct().withColumn("h", F.lit(True))
    return outcomes(spark, sf).join(held, "task", "left").groupBy(F.coalesce("h", F.lit(False)).alias("held_out")).agg(F.count("*").alias("n"))


@query("f04_joinable_keys", f"WITH {C} SELECT 'missing_' || concat_ws('_', CASE WHEN coalesce(trim(task), '') = '' THEN 'task' END, CASE WHEN plan IS NULL THEN 'plan' END) AS reason, count(*) AS n FROM c WHERE plan IS NULL OR coalesce(trim(task), '') = '' GROUP BY 1")
def f04(spark, sf):
    no_task = F.coalesce(F.trim("task"), F.lit("")) == ""
    df = outcomes(spark, sf).where(no_task | F.col("plan").isNull())
    return df.groupBy(F.concat(F.lit("missing_"), F.concat_ws("_", F.when(no_task, "task"), F.when(F.col("plan").isNull(), "plan"))).alias("reason")).agg(F.count("*").alias("n"))


@query("f06_path_roles", f"WITH {C} SELECT CASE WHEN regexp_matches(file_path, '(^|/)tests?/|(^|/)test_[^/]*$') THEN 'test' WHEN regexp_matches(file_path, '\\.(toml|cfg|ini|ya?ml|json)$') THEN 'config' WHEN regexp_matches(file_path, '\\.(md|rst|txt)$') THEN 'doc' ELSE 'source' END AS role, count(*) AS n FROM c GROUP BY 1")
def f06(spark, sf):
    p = F.col("file_path")
    role = F.when(p.rlike(r"(^|/)tests?/|(^|/)test_[^/]*$"), "test").when(p.rlike(r"\.(toml|cfg|ini|ya?ml|json)$"), "config").when(p.rlike(r"\.(md|rst|txt)$"), "doc").otherwise("source")
    return outcomes(spark, sf, "file_path").groupBy(role.alias("role")).agg(F.count("*").alias("n"))


@query("f07_preferred_match", f"""WITH {C}, {T}, p AS (SELECT name, any_value(preferred) AS preferred FROM (SELECT DISTINCT name, preferred FROM t WHERE preferred IS NOT NULL) GROUP BY name HAVING count(*) = 1)
SELECT candidate_id, c.action = p.preferred.action AND coalesce(len(list_filter(map_entries(coalesce(p.preferred.params, MAP {{}})), lambda e: c.params[e.key] IS DISTINCT FROM e.value)), 0) = 0 AS matches FROM c JOIN p ON p.name = c.task WHERE p.preferred.action IS NOT NULL""")
def f07(spark, sf):
    """Candidates whose action and parameters contain what their task prefers; names with several preferences are left out."""
    pref = tasks(spark, sf).where(F.col("preferred").isNotNull())
    pref = pref.select(F.col("name").alias("task"), F.col("preferred.action").alias("want"), F.array_sort(F.map_entries("preferred.params")).alias("wp")).distinct()
    one = pref.groupBy("task").agg(F.count("*").alias("k"), F.first("want").alias("want"), F.first("wp").alias("wp")).where((F.col("k") == 1) & F.col("want").isNotNull())
    params = read(spark, sf, "candidate_outcomes").select("candidate_id", F.map_entries("params").alias("pe")).dropDuplicates(["candidate_id"])
    got = outcomes(spark, sf, "action").join(one, "task").join(params, "candidate_id")
    has = F.coalesce(F.forall("wp", lambda e: F.coalesce(F.exists("pe", lambda x: (x["key"] == e["key"]) & x["value"].eqNullSafe(e["value"])), F.lit(False))), F.lit(True))
    return got.select("candidate_id", ((F.col("action") == F.col("want")) & has).alias("matches"))


@query("f08_confidence_bands", f"WITH {C}, s AS (SELECT CASE WHEN isnan(model_score) THEN NULL ELSE model_score END AS s FROM c) SELECT CASE WHEN s >= 0.25 THEN 'high' WHEN s >= 0.10 THEN 'medium' WHEN s >= 0.08 THEN 'low' ELSE 'none' END AS band, count(*) AS n FROM s GROUP BY 1")
def f08(spark, sf):
    s = F.when(~F.isnan("model_score"), F.col("model_score"))
    band = F.when(s >= 0.25, "high").when(s >= 0.10, "medium").when(s >= 0.08, "low").otherwise("none")
    return outcomes(spark, sf, "model_score").groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query("v01_bench_issues", f"""WITH {C}, i AS (SELECT unnest(list_filter([CASE WHEN rank_index IS NULL OR rank_index < 1 THEN 'rank_index' END, CASE WHEN passed IS NULL THEN 'passed_unknown' END, CASE WHEN model_score IS NULL OR isnan(model_score) THEN 'model_score_missing' END, CASE WHEN NOT isnan(model_score) AND abs(model_score) > 1 THEN 'model_score_range' END, CASE WHEN end_line < start_line THEN 'line_span' END, CASE WHEN NOT coalesce(json_valid(target_context), false) THEN 'target_context' END], lambda x: x IS NOT NULL)) AS issue FROM c) SELECT issue, count(*) AS n FROM i GROUP BY issue""")
def v01(spark, sf):
    nan = F.isnan("model_score")
    rules = {
        "rank_index": F.col("rank_index").isNull() | (F.col("rank_index") < 1),
        "passed_unknown": F.col("passed").isNull(),
        "model_score_missing": F.col("model_score").isNull() | nan,
        "model_score_range": ~nan & (F.abs("model_score") > 1),
        "line_span": F.col("end_line") < F.col("start_line"),
        "target_context": F.try_parse_json("target_context").isNull(),
    }
    df = outcomes(spark, sf, "model_score", "start_line", "end_line", "target_context")
    return df.select(F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in rules.items()]))).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@query("v03_unique_ids", f"WITH {TR} SELECT count(*) AS ids, count(*) FILTER (WHERE len(prompt_context.embedding) IS DISTINCT FROM prompt_jepa_target.embedding_dim) AS wrong_length, count(*) FILTER (WHERE prompt_context.embedding IS NULL) AS no_vector FROM tr")
def v03(spark, sf):
    df = transitions(spark, sf)
    n = F.when(F.col("prompt_context.embedding").isNotNull(), F.size("prompt_context.embedding"))
    return df.agg(F.count("*").alias("ids"), F.count_if(~n.cast("long").eqNullSafe(F.col("prompt_jepa_target.embedding_dim"))).alias("wrong_length"), F.count_if(F.col("prompt_context.embedding").isNull()).alias("no_vector"))


SOURCES = ["handcrafted", "mined", "synthetic", "replayed"]


@query("v05_manifest_rules", f"""WITH {T}, i AS (SELECT unnest(list_filter([CASE WHEN source_type IS NULL THEN 'source_type_missing' WHEN source_type NOT IN ('handcrafted', 'mined', 'synthetic', 'replayed') THEN 'source_type_unknown' END, CASE WHEN split IS NULL OR trim(split) = '' THEN 'split_missing' END, CASE WHEN max_steps < 1 THEN 'max_steps' END, CASE WHEN NOT regexp_full_match(name, '[a-z0-9_]+') THEN 'name_spelling' END, CASE WHEN prompt IS NULL OR length(prompt) < 20 THEN 'prompt_short' END], lambda x: x IS NOT NULL)) AS issue FROM t) SELECT issue, count(*) AS n FROM i GROUP BY issue""")
def v05(spark, sf):
    rules = [
        F.when(F.col("source_type").isNull(), "source_type_missing").when(~F.col("source_type").isin(SOURCES), "source_type_unknown"),
        F.when(F.col("split").isNull() | (F.trim("split") == ""), "split_missing"),
        F.when(F.col("max_steps") < 1, "max_steps"),
        F.when(~F.col("name").rlike("^[a-z0-9_]+$"), "name_spelling"),
        F.when(F.col("prompt").isNull() | (F.length("prompt") < 20), "prompt_short"),
    ]
    return tasks(spark, sf).select(F.explode(F.array_compact(F.array(*rules))).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


