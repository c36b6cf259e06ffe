"""Transition predictor V0: the nearest example decides the target, the mean change of the action is added to the state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymint.functions.vec import euclidean, norm, subtract
from quarrymint.operators.retrieval import encode_text, knn

#: Weights of prompt, repository and hashed categories in an input vector; length of the hashed part.
WEIGHTS, HASH_DIM = (0.44, 0.44, 0.12), 64
SOURCE_KINDS = ("source_changed", "source_unchanged")


def examples(tr: DataFrame) -> DataFrame:
    """id, action, outcome_kind, outcome_status, validation_status, prompt, before, after, input and target_kind of
    transitions. The input is the weighted parts one after another, as prompts and repositories have vectors of different
    lengths here, of unit length; null where prompt or repository has no vector. The target is a vector where the source
    outcome has one of the length of ``before``, else blocked_or_clarification."""
    before, after, prompt = F.col("repo_before.state.repo_embedding"), F.col("repo_after.state.repo_embedding"), F.col("prompt_context.embedding")
    fields = ("source_outcome.record_kind", *[f"structured_action.{c}" for c in ("kind", "repo_mode", "task_type")], *[f"outcome.{c}" for c in ("kind", "status", "failure_kind")], "validation.status")
    short = {"source_outcome": "source", "structured_action": "action"}
    name = lambda c: f"{short.get(c.split('.')[0], c.split('.')[0])}:{c.split('.')[1]}:"
    single = F.array(*[F.when(F.col(c) != "", F.concat(F.lit(name(c)), c)) for c in fields])
    lists = [F.transform(F.coalesce(F.col(f"structured_action.{c}"), F.array().cast("array<string>")), lambda x, c=c: F.concat(F.lit(f"action:{c}:"), x)) for c in ("features", "target_files")]
    hashed = encode_text(tr.select("id", F.array_compact(F.concat(single, *lists)).alias("f")), "id", F.col("f"), HASH_DIM, log=False)
    rows = tr.select("id", F.col("structured_action.kind").alias("action"), F.col("outcome.kind").alias("outcome_kind"), F.col("outcome.status").alias("outcome_status"), F.col("validation.status").alias("validation_status"), prompt.alias("prompt"), before.alias("before"), after.alias("after"))
    scaled = lambda v, w: F.transform(v, lambda x: x * w)
    parts = [scaled(v, w) for v, w in zip((F.col("prompt"), F.col("before"), F.col("v")), WEIGHTS, strict=True)]
    raw = F.concat(*parts)
    unit = F.transform(F.array(norm(raw)), lambda n: F.transform(raw, lambda x: x / F.when(n > 0, n).otherwise(1.0)))[0]  # the norm is taken once
    both = (F.size("prompt") > 0) & (F.size("before") > 0)
    source = F.col("outcome_kind").isin(*SOURCE_KINDS) & (F.size("before") > 0) & (F.size("after") == F.size("before"))
    kind = F.when(source, "repo_after_embedding").otherwise("blocked_or_clarification")
    return rows.join(hashed, "id").withColumn("input", F.when(both, unit)).drop("v").withColumn("target_kind", kind)


def _sums(ex: DataFrame, *by: str) -> DataFrame:
    """``by``, dim, the sums of the changes element by element, and their number."""
    d = ex.where(F.col("target_kind") == "repo_after_embedding").select(*by, F.size("before").alias("dim"), F.posexplode(subtract(F.col("after"), F.col("before"))).alias("i", "x"))
    s = d.groupBy(*by, "dim", "i").agg(F.round(F.sum("x"), 6).alias("s"), F.count("*").alias("n"))
    return s.groupBy(*by, "dim").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("s"), F.max("n").alias("n")).select(*by, "dim", F.col("s.s").alias("s"), "n")  # as long as a vector


def ranked(ex: DataFrame, queries: DataFrame, column: str, k: int) -> DataFrame:
    """(query, id, score, rank) of the k nearest other examples by the dot product of ``column``; ties to the larger id."""
    pick = lambda df: df.where(F.col("input").isNotNull()).select("id", F.col(column).alias("v"))
    return knn(pick(ex), pick(queries), k, "dot", "desc")


def predicted(ex: DataFrame, queries: DataFrame, near: DataFrame, leave_out: bool) -> DataFrame:
    """The prediction for each query example from its nearest one in ``near``: nearest, target_kind, outcome_kind,
    outcome_status and validation_status (of the nearest), delta_kind and the predicted vector.

    The vector is ``before`` plus the mean change of the action, of all actions where the action has none, or zero. With
    ``leave_out`` a query's own change is taken out of both means in closed form: (sum - x) / (n - 1).
    """
    best = near.where(F.col("rank") == 1).select(F.col("query").alias("id"), F.col("id").alias("nearest"))
    target = ["target_kind", "outcome_kind", "outcome_status", "validation_status"]
    of = ex.select(F.col("id").alias("nearest"), *target)
    own = F.col("own") == "repo_after_embedding"
    q = queries.select("id", "action", "before", "after", F.size("before").alias("dim"), F.col("target_kind").alias("own"))
    q = q.join(_sums(ex, "action").withColumnsRenamed({"s": "s_action", "n": "n_action"}), ["action", "dim"], "left")
    q = q.join(_sums(ex).withColumnsRenamed({"s": "s_all", "n": "n_all"}), ["dim"], "left").join(best, "id", "left").join(of, "nearest", "left")

    def mean(s: str, n: str) -> Column:
        plain = F.when(F.col(n) > 0, F.transform(s, lambda x: x / F.col(n)))
        less = F.zip_with(s, subtract(F.col("after"), F.col("before")), lambda t, x: (t - x) / (F.col(n) - 1))
        return F.when(own, F.when(F.col(n) > 1, less)).otherwise(plain) if leave_out else plain

    by_action = mean("s_action", "n_action")
    vector = F.col("target_kind") == "repo_after_embedding"
    delta = F.coalesce(by_action, mean("s_all", "n_all"), F.transform("before", lambda x: x * 0.0))
    return q.select(
        "id", "nearest", *target,
        F.when(vector, F.when(by_action.isNotNull(), "action_conditioned_average").otherwise("global_average")).alias("delta_kind"),
        F.when(vector, F.transform(F.zip_with("before", delta, lambda a, b: a + b), lambda x: F.round(x, 6))).alias("predicted"),
    )


def evaluated(ex: DataFrame, queries: DataFrame, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """Leave-one-out evaluation of the query examples that have an input, beside the nearest prompt: (one row for each
    query and model, prompt_only or v0; the same rows of v0 with the nearest example to the predicted vector).

    Rows have the expected and the first predicted outcome_kind and validation_status, whether it is among the k nearest
    (null where nothing is expected), is_residual (of either the first is missed), applicable (a source outcome) and the
    distance of the predicted vector from the true one.
    """
    queries = queries.where(F.col("input").isNotNull())
    fields = ("outcome_kind", "validation_status")
    truth = queries.select("id", *[F.when(F.col(f) != "", F.col(f)).alias(f"expected_{f}") for f in fields], F.col("outcome_kind").isin(*SOURCE_KINDS).alias("is_source"), "after", F.col("target_kind").alias("own"))
    out = []
    for model, column in (("v0", "input"), ("prompt_only", "prompt")):
        near = ranked(ex, queries, column, k)
        of = near.join(ex.select("id", *fields, F.col("target_kind").alias("kind"), F.col("after").alias("vector")), "id")
        first = lambda c: F.max_by(c, -F.col("rank"))
        top = of.groupBy(F.col("query").alias("id")).agg(first("id").alias("nearest"), *[first(f).alias(f"predicted_{f}") for f in fields], *[F.collect_list(f).alias(f"top_{f}") for f in fields], first("kind").alias("kind"), first("vector").alias("vector"))  # k rows
        j = truth.join(top, "id", "left")
        if model == "v0":
            j = j.drop("vector").join(predicted(ex, queries, near, True).select("id", F.col("predicted").alias("vector")), "id")
        hits = [F.coalesce(F.array_contains(f"top_{f}", F.col(f"expected_{f}")), F.lit(False)) for f in fields]
        missed = [~F.col(f"expected_{f}").eqNullSafe(F.col(f"predicted_{f}")) for f in fields]
        near_vector = (F.col("own") == "repo_after_embedding") & (F.col("kind") == "repo_after_embedding") & (F.size("vector") == F.size("after"))
        out.append(
            j.select(
                F.lit(model).alias("model"), "id", "nearest",
                *[c for f, h in zip(fields, hits, strict=True) for c in (F.col(f"expected_{f}"), F.col(f"predicted_{f}"), F.when(F.col(f"expected_{f}").isNotNull(), h).alias(f"top_k_{f}"))],
                (missed[0] | missed[1]).alias("is_residual"), F.coalesce("is_source", F.lit(False)).alias("applicable"),
                F.when(near_vector, F.round(euclidean(F.col("vector"), F.col("after")), 6)).alias("distance"), F.when(near_vector, F.col("vector")).alias("vector"),
            )
        )
    v0 = out[0]
    states = ex.where(F.col("target_kind") == "repo_after_embedding").select("id", F.col("after").alias("v"))
    close = knn(states, v0.select("id", F.col("vector").alias("v")), 1, "euclidean").select(F.col("query").alias("id"), F.col("id").alias("nearest_state"), F.col("score").alias("nearest_state_distance"))
    return v0.unionByName(out[1]).drop("vector"), v0.drop("vector").join(close, "id", "left")
