import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymint.llm.overlap import banded_distance, layout, lengths_for, member_pairs, most_edits, overlap_counts, segment_keys, similar_across, substrings


def words(t):
    return set(re.findall("[a-z0-9_]+", (t or "").lower()))


def brute(rows, t):
    out = set()
    for a, x, s in rows:
        for b, y, u in rows:
            p, q = words(x), words(y)
            if s == "eval" and u == "train" and p and q and len(p & q) >= t * len(p | q):
                out.add((a, b))
    return out


def run(spark, rows, t):
    df = spark.createDataFrame(rows, "id long, text string, side string").withColumn("c", F.lit(1)).withColumn("w", F.lit(2))
    pairs, members = similar_across(df, "id", "text", F.col("side"), t)
    left, right = ({}, {})
    for r in members.collect():
        (left if r["side"] == "eval" else right).setdefault(r["c"], []).append(r["id"])
    got = [(a, b) for r in pairs.collect() for a in left[r["c_eval"]] for b in right[r["c_train"]]]
    assert len(got) == len(set(got))
    return set(got)


def corpus(seed, size):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    bases = [[rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 3, 4, 5, 9, 20, 45]))] for _ in range(12)]
    rows = []
    for i in range(size):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 2, 4, 6])):
            at = rnd.randrange(len(w) + 1)
            if rnd.random() < 0.5 and len(w) > 1:
                w.pop(min(at, len(w) - 1))
            else:
                w.insert(at, rnd.choice(vocabulary + [f"x{i}"]))
        rows.append((i, rnd.choice([" ", ", ", "\n"]).join(w).upper() if i % 3 else " ".join(w), rnd.choice(["train", "eval", "other"])))
    return rows


@pytest.mark.parametrize("t", [0.75, 0.8, 1.0])
def test_matches_brute_force(spark, t):
    rows = corpus(int(t * 100), 260)
    assert run(spark, rows + rows[:20], t) == brute(rows, t)


def test_nulls_empty_copies_and_long_texts(spark):
    long = " ".join(f"v{i}" for i in range(3000))
    rows = [(1, None, "eval"), (2, "", "train"), (3, "!!!", "eval"), (4, "a b", "eval"), (5, "B a", "train"), (6, "a b", "train"), (7, long, "eval"), (8, long + " more words", "train"), (9, "a b", None)]
    assert run(spark, rows, 0.75) == {(4, 5), (4, 6), (7, 8)}
    assert run(spark, [], 0.75) == set()


def test_similarity_must_be_above_a_half(spark):
    with pytest.raises(ValueError):
        similar_across(spark.createDataFrame([], "id long, text string"), "id", "text", F.lit("eval"), 0.5)


def test_every_close_pair_shares_a_segment():
    rnd = random.Random(9)
    for _ in range(400):
        n = rnd.randrange(1, 40)
        x = sorted(rnd.sample(range(120), n))
        y = sorted((set(x) - set(rnd.sample(x, rnd.randrange(0, n // 4 + 1)))) | set(rnd.sample(range(120), rnd.randrange(0, n // 4 + 1))))
        if not y or len(set(x) & set(y)) < 0.75 * len(set(x) | set(y)):
            continue
        lay = layout(n, 0.75)
        assert len(lay) == most_edits(n, 0.75) + 1 and sum(k for _, k in lay) == n and len(y) in lengths_for(n, 0.75)
        p, ln = (np.array(v) for v in zip(*lay, strict=True))
        mine = set(segment_keys(np.array(x), p, ln).tolist())
        assert mine & set(segment_keys(np.array(y), *substrings(len(y), 0.75)).tolist())


def test_banded_distance():
    rnd = random.Random(4)
    xs, ys = [], []
    for _ in range(200):
        x = rnd.sample(range(40), rnd.randrange(1, 25))
        y = [v for v in x if rnd.random() < 0.9] or [99]
        xs.append(np.array(sorted(x)))
        ys.append(np.array(sorted(y)))
    d = banded_distance(xs, ys, 0.75)
    for x, y, got in zip(xs, ys, d, strict=True):
        want = len(set(x) ^ set(y))
        assert got == want or (got > want and want > (len(x) + len(y)) / 7)


def test_long_strings_list_every_place_that_short_ones_do(monkeypatch):
    import quarrymint.llm.overlap as overlap

    for m in (1, 2, 7, 40, 300):
        few = set(zip(*(v.tolist() for v in substrings.__wrapped__(m, 0.75)), strict=True))
        monkeypatch.setattr(overlap, "LONG", 0)
        many = set(zip(*(v.tolist() for v in substrings.__wrapped__(m, 0.75)), strict=True))
        monkeypatch.undo()
        assert few <= many and len(many) < 8 * m + 8
    pos, ln = substrings.__wrapped__(300_000, 0.75)
    assert len(pos) < 3_000_000 and (pos + ln <= 300_000).all()


def test_counts_and_pairs_of_members_with_hot_classes(spark, monkeypatch):
    import quarrymint.session as session

    monkeypatch.setattr(session, "SALTS", 3)
    rows = corpus(5, 200) + [(1000 + i, "same words here", "eval" if i % 2 else "train") for i in range(80)] + [(2000, None, "eval")]
    df = spark.createDataFrame(rows, "id long, text string, side string").withColumn("g", F.col("id") % 3)
    pairs, members = similar_across(df, "id", "text", F.col("side"), 0.75, {"g": F.col("g")})
    want = brute(rows, 0.75)
    assert sorted((r["eval_id"], r["train_id"]) for r in member_pairs(pairs, members, "id").collect()) == sorted(want)
    got = {r["g"]: (r["overlapping"], r["pairs"]) for r in overlap_counts(pairs, members, ["g"]).collect()}
    assert got == {g: (len({a for a, _ in want if a % 3 == g}), sum(a % 3 == g for a, _ in want)) for g in range(3)}


@pytest.mark.parametrize("name", ["p5_found", "p5_counts"])
def test_no_side_is_broadcast(spark, name):
    from quarrymint.llm.overlap_queries import QUERIES

    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    df.collect()
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
