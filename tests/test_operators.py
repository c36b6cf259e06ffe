import hashlib
import math
import random
from inspect import signature

import duckdb
import pytest
from pyspark.sql import functions as F

from quarrymint.functions.hashing import percent64, percent256, signed_bucket, stable_fraction, stable_split
from quarrymint.functions.text import bucket, jaccard, ngrams, normalized, tokens
from quarrymint.functions.vec import cosine, normalize
from quarrymint.operators import retrieval
from quarrymint.operators.joins import bounded_walk, leave_one_out, one_per_key, outer_with_status, overlap_counts
from quarrymint.operators.learners import fit_pairwise, fit_perceptron, linear_score, predict
from quarrymint.operators.ranking import evenly_spaced, evenly_spaced_by, movement, numbered, pass_change, round_robin, top_k
from quarrymint.operators.retrieval import encode_text, knn, prototype_score
from quarrymint.operators.rollup import by_dimensions, calibration, majority, rank_metrics, sigmoid
from tests.oracle import same


def test_hashes_equal_hashlib(spark):
    keys = ["", "a", "naïve", "x" * 300] + [f"k{i}" for i in range(50)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    b, s = signed_bucket(F.col("k"), 64)
    for r in df.select("k", percent64(F.col("k")).alias("p"), percent256(F.col("k")).alias("q"), stable_fraction(F.col("k")).alias("f"), b.alias("b"), s.alias("s")).collect():
        d = hashlib.sha256(r["k"].encode()).digest()
        first = int.from_bytes(d[:8], "big")
        assert (r["p"], r["q"], r["b"], r["s"]) == (first % 100, int.from_bytes(d, "big") % 100, first % 64, 1.0 if d[8] % 2 == 0 else -1.0)
        assert abs(r["f"] - first / (2**64 - 1)) < 1e-12


def test_split_bounds_are_data(spark):
    df = spark.range(100).select(stable_split(F.col("id"), ((70, "a"), (85, "b"), (100, "c"))).alias("s"))
    assert {r["s"]: r["count"] for r in df.groupBy("s").count().collect()} == {"a": 70, "b": 15, "c": 15}


def test_numbered_equals_row_number_and_ignores_partitioning(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["hot"] * 9 + ["a", None]), rnd.choice([None, 1, 2])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g string, r long")
    order = [F.col("r").asc_nulls_last(), F.col("id").asc()]
    want = {}
    for g in {r[1] for r in rows}:
        for p, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is None, r[2] or 0, r[0])), 1):
            want[r[0]] = p
    for parts in (1, 7):
        assert {r["id"]: r["position"] for r in numbered(df.repartition(parts), ["g"], order).collect()} == want


def test_top_k_is_limited_before_the_shuffle(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    q = top_k(df, ["g"], [F.desc("id")], 2)
    assert "WindowGroupLimit" in q._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["id"] for r in q.collect()) == [94, 95, 96, 97, 98, 99]


def test_samples(spark):
    df = spark.range(11)
    assert [r["id"] for r in evenly_spaced(df, [F.col("id")], 5).orderBy("id").collect()] == [0, 2, 5, 8, 10]
    assert evenly_spaced(df, [F.col("id")], 50).count() == 11 and evenly_spaced(df, [F.col("id")], 0).count() == 0
    g = df.withColumn("g", F.when(F.col("id") < 8, "a").otherwise("b"))
    assert sorted(r["id"] for r in round_robin(g, "g", [F.col("id")], 3, 4).collect()) == [0, 1, 8, 9]


def test_movement_labels(spark):
    rows = [(1, 1), (2, 1), (1, 3), (None, 2), (2, None), (None, None)]
    df = spark.createDataFrame(rows, "o long, n long").select(movement(F.col("o"), F.col("n")).alias("m"), pass_change(F.col("o"), F.col("n")).alias("p"))
    assert [tuple(r) for r in df.collect()] == [("unchanged", "kept"), ("+1", "gained"), ("-2", "lost"), ("found", "missed"), ("lost", "missed"), ("missing", "missed")]


def test_outer_join_statuses_partition_the_result(spark):
    a = spark.createDataFrame([("x", "1", 1), ("x", "1", 2), ("y", " ", 3), (None, "1", 4)], "k string, j string, va long")
    b = spark.createDataFrame([("x", "1", 5), ("y", " ", 6), ("z", "1", 7)], "k string, j string, vb long")
    rows = outer_with_status(a, b, ["k", "j"], "left", "right").collect()
    assert sorted((r["join_status"], r["unjoined_reason"] or "", r["va"] or 0, r["vb"] or 0) for r in rows) == [
        ("joined", "", 1, 5), ("joined", "", 2, 5), ("unjoined_left", "missing_j", 3, 0), ("unjoined_left", "missing_k", 4, 0), ("unjoined_right", "missing_j", 0, 6), ("unjoined_right", "no_match", 0, 7),
    ]
    assert outer_with_status(a.where("false"), b, ["k", "j"], "left", "right").count() == 3


def test_duplicate_key_policies(spark):
    df = spark.createDataFrame([("a", 1, "p"), ("a", 2, "q"), ("b", 1, None)], "k string, t long, v string")
    assert {r["k"]: r["v"] for r in one_per_key(df, ["k"], F.col("t")).collect()} == {"a": "p", "b": None}
    assert {r["k"]: r["v"] for r in one_per_key(df, ["k"], F.col("t"), last=True).collect()} == {"a": "q", "b": None}


def test_overlap_counts_equal_pairs(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["a", "b", None]), rnd.choice([None, rnd.randrange(30)]), rnd.choice([None, rnd.randrange(30)])) for i in range(150)]
    got = {r["id"]: r["overlapping"] for r in overlap_counts(spark.createDataFrame(rows, "id long, g string, s long, e long"), ["g"], "s", "e").collect()}
    ok = [r for r in rows if r[2] is not None and r[3] is not None and r[2] <= r[3]]
    for i, g, s, e in rows:
        assert got[i] == (sum(o[1] == g and o[0] != i and s <= o[3] and o[2] <= e for o in ok) if (i, g, s, e) in ok else 0)


def test_leave_one_out_and_walk(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, "a", None), (4, "b", 5.0)], "id long, g string, x double")
    assert {r["id"]: r["others_mean"] for r in leave_one_out(df, ["g"], "x").collect()} == {1: 3.0, 2: 1.0, 3: 2.0, 4: None}
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "a long, b long")
    assert {(r["node"], r["distance"]) for r in bounded_walk(edges, spark.createDataFrame([(1,)], "node long"), 3).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}


def test_rollups(spark):
    df = spark.createDataFrame([("a", 1, 2), ("b", None, 3), (None, 2, 4)], "g string, first long, n long")
    got = {(r["dimension"], r["value"]): r["groups"] for r in by_dimensions(df, {"all": None, "g": F.col("g")}, *rank_metrics(F.col("first"), F.col("n"))).collect()}
    assert got == {("all", "*"): 3, ("g", "a"): 1, ("g", "b"): 1, ("g", "(none)"): 1}
    one = df.agg(*rank_metrics(F.col("first"), F.col("n"))).first()
    assert (one["solved"], one["pass_at_1"], one["mrr"], one["mrr_solved"], one["avg_before"], one["residual"]) == (2, 1, 0.5, 0.75, 1.333333, 1)
    assert df.where("false").agg(*rank_metrics(F.col("first"), F.col("n"))).first()["mrr"] == 0.0


def test_calibration_keeps_empty_buckets(spark):
    df = spark.createDataFrame([(0.0, True), (1.0, False), (0.95, True), (None, True), (float("nan"), True), (0.5, None)], "p double, y boolean")
    rows = calibration(df, F.col("p"), F.col("y")).orderBy("bucket").collect()
    assert [r["n"] for r in rows] == [1, 0, 0, 0, 2]
    assert [r["n"] for r in calibration(df.where("false"), F.col("p"), F.col("y")).collect()] == [0] * 5
    big = spark.createDataFrame([(-1000.0,), (1000.0,)], "x double").select(sigmoid(F.col("x")).alias("s")).collect()
    assert [r["s"] for r in big] == [0.0, 1.0]


def test_majority_ties_go_to_the_smallest(spark):
    df = spark.createDataFrame([("a", "z"), ("a", "b"), ("c", "q")], "g string, v string")
    assert {r["g"]: r["majority"] for r in majority(df, ["g"], "v").collect()} == {"a": "b", "c": "q"}


def test_text_and_vectors(spark):
    df = spark.createDataFrame([("  A  b\tC ", [3.0, 4.0], [0.0, 0.0])], "t string, v array<double>, z array<double>")
    r = df.select(normalized(F.col("t")).alias("n"), ngrams(tokens(F.col("t")), 2).alias("g"), ngrams(tokens(F.col("t")), 2, 2).alias("k"), ngrams(tokens(F.col("t")), 5).alias("e"), jaccard(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b"))).alias("j"), normalize(F.col("v")).alias("u"), normalize(F.col("z")).alias("z"), cosine(F.col("v"), F.col("z")).alias("c"), bucket(F.lit(5)).alias("b")).first()
    assert (r["n"], r["g"], r["k"], r["e"], r["j"], r["u"], r["z"], r["c"], r["b"]) == ("a b c", ["a b", "b c"], ["a c"], [], 0.5, [0.6, 0.8], [0.0, 0.0], 0.0, "4_7")


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_knn_ties_and_blocks(spark, metric, monkeypatch):
    import quarrymint.operators.retrieval as retrieval

    monkeypatch.setattr(retrieval, "QUERY_BYTES", 64)
    rows = [(i, [1.0, 0.0]) for i in range(6)] + [(9, [0.0, 1.0]), (10, None), (11, [1.0])]
    p = spark.createDataFrame(rows, "id long, v array<double>")
    got = [(r["query"], r["id"]) for r in knn(p, p.where("id in (0, 3)"), 2, metric).orderBy("query", "rank").collect()]
    assert got == [(0, 1), (0, 2), (3, 0), (3, 1)]
    down = [(r["query"], r["id"]) for r in knn(p, p.where("id in (0, 3)"), 2, metric, "desc").orderBy("query", "rank").collect()]
    assert down == [(0, 5), (0, 4), (3, 5), (3, 4)]
    assert knn(p, p.where("false"), 2, metric).count() == 0


def test_text_encoder_and_prototypes(spark):
    df = spark.createDataFrame([(1, "a b b"), (2, "b b a"), (3, ""), (4, None)], "id long, t string")
    v = {r["id"]: r["v"] for r in encode_text(df, "id", tokens(F.col("t")), 16).collect()}
    assert v[1] == v[2] and abs(sum(x * x for x in v[1]) - 1) < 1e-9 and v[3] == v[4] == [0.0] * 16
    r = spark.range(1).select(prototype_score([(0.5, F.lit(0.4)), (0.3, F.lit(None).cast("double"))]).alias("a"), prototype_score([(0.5, F.lit(None).cast("double"))]).alias("b")).first()
    assert (r["a"], r["b"]) == (0.4, -1.0)


def test_learners(spark):
    pairs = spark.createDataFrame([(1, [1.0, -1.0]), (2, [0.5, 0.0])], "k long, diff array<double>")
    w = fit_pairwise(pairs, "k", ["good", "bad"])
    assert w["good"] > 0 > w["bad"] and fit_pairwise(pairs.where("false"), "k", ["good"]) == {}
    f = spark.createDataFrame([(1, "good", 2.0), (1, "new", 9.0)], "id long, name string, value double")
    assert linear_score(f, "id", {"good": 1.5}, 1.0).first()["score"] == 4.0
    df = spark.createDataFrame([(1, "red hot", "x"), (2, "blue cold", "y"), (3, "red", "x"), (4, "cold", "y"), (5, "q", None)], "id long, t string, y string")
    weights = fit_perceptron(df, "id", tokens(F.col("t")), F.col("y"))
    assert {r["id"]: r["predicted"] for r in predict(weights, df, "id", tokens(F.col("t"))).collect()} == {1: "x", 2: "y", 3: "x", 4: "y", 5: "y"}


@pytest.mark.parametrize("first", [None, [], [1.0, 0.0], [1.0, 0.0, 0.0]])
def test_knn_of_every_length(spark, first):
    rnd = random.Random(3)
    rows = [(0, first)] + [(i, [rnd.random() for _ in range(2 + i % 2)]) for i in range(1, 13)] + [(13, None), (14, [])]
    df = spark.createDataFrame(rows, "id long, v array<double>").coalesce(1)
    want = set()
    for q, a in rows:
        near = sorted((math.dist(a, b), i) for i, b in rows if a and b and len(a) == len(b) and i != q)
        want |= {(q, i, n) for n, (_, i) in enumerate(near[:2], 1)}
    assert {(r["query"], r["id"], r["rank"]) for r in knn(df, df, 2, "euclidean").collect()} == want
    assert knn(df, df.where(F.size("v") < 1), 2).count() == 0


@pytest.mark.parametrize("ties", ["asc", "desc"])
def test_knn_in_slices(spark, monkeypatch, ties):
    monkeypatch.setattr(retrieval, "SCORE_BYTES", 8 * 40 * 3)
    rows = [(f"r{i:02}", [float(i % 4), float(i % 3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, v array<double>").coalesce(2)
    got = {}
    for r in knn(df, df, 3, "dot", ties).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["id"])
    for q, a in rows:
        near = sorted((i for i, _ in rows if i != q), reverse=ties == "desc")
        assert got[q] == sorted(near, key=lambda i: -sum(x * y for x, y in zip(a, dict(rows)[i], strict=True)))[:3]


def test_even_samples_of_groups(spark):
    rows = [(g, i) for g, n in (("a", 1), ("b", 5), ("c", 6), ("d", 11), ("e", 97), (None, 20)) for i in range(n)]
    got = {}
    for r in evenly_spaced_by(spark.createDataFrame(rows, "g string, i long"), "g", [F.col("i")], 5).collect():
        got.setdefault(r["g"], set()).add(r["i"])
    for g in {g for g, _ in rows}:
        n = sum(x == g for x, _ in rows)
        assert got[g] == (set(range(n)) if n <= 5 else {round(i * ((n - 1) / 4)) for i in range(5)})


def test_r10_exemplars_change_the_score(spark, tmp_path):
    from quarrymint.plans import registry

    rnd = random.Random(2)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(4)], i % 3) for i in range(900)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    full = registry.queries()["r10_exemplar_scores"](spark, str(tmp_path))
    same(full, con, registry.oracle_sql()["r10_exemplar_scores"])
    plain = {r["vec_id"]: r["score"] for r in registry.queries()["r10_prototype_scores"](spark, str(tmp_path)).collect()}
    assert sum(abs(r["score"] - plain[r["vec_id"]]) > 1e-3 for r in full.collect()) > 800


def test_predicted_targets_are_evaluated(spark, tmp_path):
    from quarrymint.plans import registry

    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(6)], i % 3) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    vec, label = {i: v for i, v, _ in rows}, {i: y for i, _, y in rows}
    size = lambda v: math.sqrt(sum(x * x for x in v))
    near = lambda v, own, k: [i for _, i in sorted((-round(sum(a * b for a, b in zip(v, w, strict=True)) / size(v) / size(w), 6), i) for i, w in vec.items() if i != own)[:k]]
    found = {}
    for q in range(0, 200, 20):
        one = near(vec[q], q, 1)[0]
        target = near(vec[one], one, 1)[0]
        found[q] = near([a + c - b for a, b, c in zip(vec[q], vec[one], vec[target], strict=True)], q, 3)
    top_1, top_3 = sum(label[f[0]] == label[q] for q, f in found.items()), sum(label[q] in map(label.get, f) for q, f in found.items())
    r = registry.queries()["r08_predicted_target_accuracy"](spark, str(tmp_path)).first().asDict()
    assert r == {"queries": 10, "top_1": top_1, "top_3": top_3, "top_1_accuracy": top_1 / 10, "top_3_accuracy": top_3 / 10, "missed_top_1": 10 - top_1, "missed_top_3": 10 - top_3}
    misses = registry.queries()["r08_misses"](spark, str(tmp_path)).collect()
    assert [(m["query"], m["nearest"]) for m in misses] == [(q, f[0]) for q, f in found.items() if label[f[0]] != label[q]]


def test_m14_fits_ten_epochs(spark, monkeypatch, tmp_path):
    from quarrymint.plans import order_queries

    asked = []
    fit = order_queries.fit_perceptron
    monkeypatch.setattr(order_queries, "fit_perceptron", lambda *a, **k: asked.append(signature(fit).bind(*a, **k)) or fit(*a, **k))
    rows = [(i, "train" if i % 4 else "test", f"w{i % 2} x{i % 3}", "ab"[i % 2], 0) for i in range(20)]
    spark.createDataFrame(rows, "task_id long, split string, prompt string, source_type string, ingested_at long").write.parquet(str(tmp_path / "tasks.parquet"))
    assert order_queries.QUERIES["m14_token_perceptron"](spark, str(tmp_path)).count() > 0
    asked[0].apply_defaults()
    assert asked[0].arguments["epochs"] == 10
