import math
import random

import pytest
from pyspark.sql import functions as F

import quarrymint.llm.topn as topn
from quarrymint.llm.topn import group_key, top_n

SCHEMA = "id long, g string, s double, h double, r long, rank string"
TIES = (("h", "desc"), ("r", "asc"))


def brute(rows, n):
    bad = lambda x: x is None or (isinstance(x, float) and math.isnan(x))
    down = lambda x: (1, 0) if bad(x) else (0, -x)
    up = lambda x: (1, 0) if bad(x) else (0, x)
    groups = {}
    for i, g, s, h, r, _ in {x[0]: x for x in rows}.values():
        groups.setdefault(g, []).append((down(s), down(h), up(r), i))
    return {x[3] for v in groups.values() for x in sorted(v)[:n]}


def run(spark, rows, n):
    df = spark.createDataFrame(rows, SCHEMA)
    return [r["id"] for r in top_n(df, [F.col("g")], "s", TIES, "id", n).collect()]


def rows_of(seed, size):
    rnd = random.Random(seed)
    score = lambda: rnd.choice([None, float("nan"), -0.0, 0.0, 1.0, rnd.random(), rnd.random() * 9])
    out = [(i, rnd.choice(["hot"] * 6 + ["a", "b", None, ""]), score(), score(), rnd.choice([None, 1, 2, 3]), "clash") for i in range(size)]
    return out + rnd.sample(out, size // 10)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("n", [1, 3])
def test_matches_brute_force(spark, seed, n):
    rows = rows_of(seed, 300)
    got = run(spark, rows, n)
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, n)


@pytest.mark.parametrize("hot", [True, False])
def test_full_groups_leave_before_the_ranking(spark, monkeypatch, hot):
    if not hot:
        monkeypatch.setattr(topn, "hot_values", lambda df, key: [])
    plans, cut = [], topn.cut
    monkeypatch.setattr(topn, "cut", lambda df, label, by=None: plans.append((label, df._jdf.queryExecution().optimizedPlan().toString())) or cut(df, label, by))
    rows = rows_of(3, 300)
    assert set(run(spark, rows, 3)) == brute(rows, 3)
    later = [p for label, p in plans if label.startswith("topn-band") and label[9:] in ("1", "2", "3")]
    assert len(later) == 3
    for p in later:
        assert p.index("Window [") < p.index("LeftAnti") and "strategy=merge" in p and "strategy=broadcast" not in p


def test_all_scores_equal_or_missing(spark):
    rows = [(i, "g", 1.0, None, None, "") for i in range(20)]
    assert set(run(spark, rows, 3)) == {0, 1, 2}
    assert set(run(spark, [(i, "g", None, None, None, "") for i in range(9)], 2)) == {0, 1}


def test_empty_table_and_no_places(spark):
    assert run(spark, [], 3) == []
    assert run(spark, [(1, "g", 1.0, None, None, "")], 0) == []


def test_group_keys_do_not_run_together(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "abc"), ("", "abc")], "x string, y string")
    assert df.select(group_key([F.col("x"), F.col("y")]).alias("k")).distinct().count() == 4


def test_key_may_be_called_rank(spark):
    df = spark.createDataFrame([(1, "g", 2.0)], "rank long, g string, s double")
    assert top_n(df, [F.col("g")], "s", (), "rank", 1).columns == ["rank_", "group_key", "rank"]
