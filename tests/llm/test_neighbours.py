import numpy as np
import pytest
from pyspark.sql import functions as F

import quarrymint.llm.neighbours as neighbours
from quarrymint.llm.neighbours import fit_tree, nearest


def brute(rows, k, least):
    ok = {}
    for i, v, d in rows:
        if i is not None and v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v) / np.abs(v).max()
    out = {}
    for i, v in ok.items():
        near = [(-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 6), j) for j, w in ok.items() if j != i and len(w) == len(v)]
        out[i] = [(j, -s) for s, j in sorted(near)[:k] if -s >= least]
    return {(i, j, r + 1) for i, v in out.items() for r, (j, _) in enumerate(v)}


def run(spark, rows, k=3, least=-1.0, report=None):
    df = spark.createDataFrame(rows, "id string, v array<double>, d long").withColumn("leaf", F.lit(1)).withColumn("x", F.lit(1))
    return {(r["id"], r["neighbour"], r["rank"]) for r in nearest(df, "id", F.col("v"), F.col("d"), k, least, report=report).collect()}


def vectors(seed, n, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return [(f"{i:05d}", (centres[i % 12] + rng.normal(size=dim) * 0.2).tolist(), dim) for i in range(n)]


BAD = [("n", None, 8), ("e", [], 8), ("z", [0.0] * 8, 8), ("i", [float("inf")] * 8, 8), ("q", [float("nan")] * 8, 8), ("h", [1.0, None] * 4, 8), ("d", [1.0] * 8, 9), ("m", [1.0] * 8, None), (None, [1.0] * 8, 8)]


@pytest.mark.parametrize("least", [-1.0, 0.9])
def test_small_input_is_exact(spark, least):
    rows = vectors(1, 200) + vectors(2, 40, 5)[:0] + [(f"s{i}", v, d) for i, v, d in vectors(3, 40, 5)] + BAD
    assert run(spark, rows + rows[:15], 3, least) == brute(rows, 3, least)


def test_copies_and_ties(spark):
    rows = [(f"c{i:02d}", [1.0, 2.0, 0.5], 3) for i in range(30)] + [("far", [-1.0, 0.0, 0.0], 3), ("scaled", [2.0, 4.0, 1.0], 3)]
    assert run(spark, rows, 3, 0.9) == brute(rows, 3, 0.9)


def test_empty_and_alone(spark):
    assert run(spark, []) == set() and run(spark, BAD) == set() and run(spark, vectors(1, 1)) == set()


def unit(seed, n, d):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


def test_many_leaves_and_blocks_reach_the_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF_SIZE", 10)
    monkeypatch.setattr(neighbours, "POINT_BLOCK", 25)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 60)
    rows, report = vectors(4, 1200), {}
    want, got = brute(rows, 3, 0.5), run(spark, rows, 3, 0.5, report)
    assert report[8]["leaves"] > 60 and 1 < report[8]["visits"] < report[8]["leaves"] and report[8]["recall"] >= 0.998
    assert len(want & got) >= 0.97 * len(want)


def test_visits_start_at_one_and_widen_until_the_recall_is_reached(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF_SIZE", 10)
    rows, seen = vectors(5, 800), []
    for recall in (0.1, 0.9, 1.0):
        report = {}
        df = spark.createDataFrame(rows, "id string, v array<double>, d long")
        nearest(df, "id", F.col("v"), F.col("d"), 3, recall=recall, report=report)
        assert report[8]["recall"] >= recall
        seen.append(report[8]["visits"])
    assert seen[0] == 1 and seen[0] < seen[1] < seen[2]


def test_best_bin_first_visits_every_leaf_once():
    x = unit(0, 600, 6)
    tree = fit_tree(x, 90)
    assert len(tree.leaves) > 60
    order = tree.visits(x[:20], len(tree.leaves))
    assert all(sorted(r) == sorted(tree.leaves) for r in order.tolist())


def test_only_children_of_opened_nodes_are_compared():
    x = unit(1, 20_000, 6)
    tree = fit_tree(x, 1500)
    assert len(tree.leaves) > 1000
    first = tree.visits(x[:50], 4)
    assert tree.compared < 0.2 * 50 * len(tree.leaves)
    assert (first == tree.visits(x[:50], 30)[:, :4]).all()


def test_the_tree_grows_with_the_vectors():
    depth = lambda t: len(set(np.searchsorted(t.first, range(len(t.first)))))
    small, large = fit_tree(unit(2, 4000, 6), 30), fit_tree(unit(2, 4000, 6), 900)
    assert len(small.leaves) < 60 < 500 < len(large.leaves) and depth(small) < depth(large)
    assert len(fit_tree(unit(2, 1, 6), 1).leaves) == 1 and (fit_tree(unit(2, 1, 6), 1).visits(unit(3, 4, 6), 9) == 0).all()
