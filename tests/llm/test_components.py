import random

import pytest
from pyspark.sql import functions as F

import quarrymint.llm.components as components
import quarrymint.session as session
from quarrymint.llm.components import deal_splits, linked_groups


def brute(rows):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = {}
    for k, *values in rows:
        if k is None:
            continue
        parent.setdefault(k, k)
        for i, v in enumerate(values):
            if v is not None:
                other = seen.setdefault((i, v), k)
                a, b = find(k), find(other)
                parent[max(a, b)] = min(a, b)
    return {k: find(k) for k in parent}


def run(spark, rows):
    df = spark.createDataFrame(rows, "id long, name string, family string").withColumn("node", F.lit("clash")).withColumn("root", F.lit(1))
    groups, forest = linked_groups(df, "id", [F.col("name"), F.col("family")])
    return {r["node"]: r["root"] for r in groups.collect()}, forest


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_and_forest(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice([None, f"n{rnd.randrange(150)}"]), rnd.choice([None, "big", f"f{rnd.randrange(60)}"]) if i % 5 else None) for i in range(200)]
    got, forest = run(spark, rows + rows[:10])
    want = brute(rows)
    assert got == want
    edges = forest.collect()
    assert len(edges) == len(want) - len(set(want.values()))  # spans, without a cycle
    assert brute([(e["a"], f"{i}") for i, e in enumerate(edges)] + [(e["b"], f"{i}") for i, e in enumerate(edges)]).items() <= want.items()


def test_a_long_chain(spark):
    rows = [(i, f"n{i // 2}", f"f{(i + 1) // 2}") for i in range(60)]
    assert set(run(spark, rows)[0].values()) == {0}


@pytest.mark.parametrize("small", [True, False])
def test_hot_values_and_labels_are_spread(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(components, "BROADCAST_BYTES", -1)
        monkeypatch.setattr(session, "BROADCAST_BYTES", -1)
    rows = [(i, f"n{i // 2}", f"f{(i + 1) // 2}" if i % 3 else None) for i in range(200, 260)] + [(i, "same", None) for i in range(40)] + [(100, None, "x"), (101, None, "x")]
    assert run(spark, rows)[0] == brute(rows)


def test_no_links_nulls_and_empty(spark):
    assert run(spark, [(1, None, None), (2, "a", None), (None, "a", None)])[0] == {1: 1, 2: 2}
    assert run(spark, [])[0] == {}
    assert run(spark, [(1, "x", None), (2, None, "x")])[0] == {1: 1, 2: 2}  # a name is no family


def test_splits_keep_groups_and_shares(spark):
    rnd = random.Random(5)
    rows = [(i, i // 40 if i < 400 else (i if rnd.random() < 0.5 else i - i % 3)) for i in range(4000)]
    roots = {}
    for i, g in rows:
        roots.setdefault(g, i)
    groups = spark.createDataFrame([(i, roots[g]) for i, g in rows], "node long, root long")
    shares = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1), ("none", None), ("zero", 0.0)], "split string, target_share double")
    got = deal_splits(groups, shares).collect()
    assert len(got) == len(rows)
    of = {}
    for r in got:
        assert of.setdefault(r["root"], r["split"]) == r["split"]
    for split, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
        assert abs(sum(r["split"] == split for r in got) / len(rows) - share) < 0.02


def test_splits_of_nothing(spark):
    shares = spark.createDataFrame([("train", 1.0)], "split string, target_share double")
    assert deal_splits(spark.createDataFrame([], "node long, root long"), shares).count() == 0
    one = deal_splits(spark.createDataFrame([(1, 1)], "node long, root long"), shares.where("false")).collect()
    assert one[0]["split"] is None
