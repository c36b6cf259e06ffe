import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from quarrymint.functions.python_udfs import ast_features, blake2b_cell, blake2b_tenth
from quarrymint.functions.text import lexical_tokens
from quarrymint.operators.extension import evaluate_predictions, ranked_by
from quarrymint.operators.learners import fit_pairwise, fit_perceptron, predict
from quarrymint.operators.splits import group_split
from quarrymint.operators.trees import flat_features, json_nodes, keys_found, numbers_of

LINES = [(1, '{"a": {"b": [1, "x", null, {"c": true}], "d": 0.5}, "e": []}'), (2, "[[2], {\"a\": -1}]"), (3, "not json"), (4, None), (5, ""), (6, "7"), (7, '{"a": NaN}')]


@pytest.fixture(scope="module")
def nodes(spark):
    df = spark.createDataFrame(LINES, "path long, line string").withColumn("name", F.lit("clash"))
    return json_nodes(df, "path", "line", "r")


def test_features_of_nested_records(nodes):
    got = sorted((r[0], r[1]) for r in flat_features(nodes, "path_").collect())
    one = ["r.a:present", "r.a.b:present", "r.a.b:len=4", "r.a.b:item=1", "r.a.b:item=x", "r.a.b:item=null", "r.a.b[].c:present", "r.a.b[].c=true", "r.a.d:present", "r.a.d=0.5", "r.e:present", "r.e:len=0"]
    assert got == sorted([(1, f) for f in one] + [(2, "r:len=2"), (2, "r[]:len=1"), (2, "r[]:item=2"), (2, "r[].a:present"), (2, "r[].a=-1"), (6, "r=7")])


def test_keys_and_numbers_at_any_depth(nodes):
    assert sorted(tuple(r) for r in keys_found(nodes, "path_", ["a", "c"]).collect()) == [(1, "a", 1), (1, "c", 1), (2, "a", 1)]
    assert sorted((r["path_"], r["name"], r["number"]) for r in numbers_of(nodes, F.col("name").isin("a", "c", "d")).collect()) == [(1, "d", 0.5), (2, "a", -1.0)]


def test_deep_and_empty(spark):
    deep = "[" * 800 + "]" * 800
    df = spark.createDataFrame([(1, deep), (2, "[" * 200_000)], "k long, line string")
    assert json_nodes(df, "k", "line").count() == 800
    assert json_nodes(df.where("false"), "k", "line").count() == 0


def test_lexical_tokens(spark):
    texts = ["The retries_validate parsing of CLASS and bus", "", None, "ties ing validator is"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(lexical_tokens(F.col("t"))).collect()]
    assert got[0] == sorted({"retries", "retry", "retrie", "validate", "validation", "parsing", "pars", "of", "class", "clas", "bus"} - {"bus"} | {"bus"})
    assert got[1] == [] and got[2] is None
    assert got[3] == sorted({"ties", "ty", "tie", "ing", "validator", "validate", "validation", "is"})


def test_blake2b_cells(spark):
    words = ["alpha", "beta", "", "né", None]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(blake2b_cell(F.col("w"), 64)).collect()]
    for w, cell in zip(words, got, strict=True):
        if w is not None:
            d = hashlib.blake2b(w.encode(), digest_size=8).digest()
            assert tuple(cell) == (int.from_bytes(d[:4], "big") % 64, 1.0 if d[4] % 2 == 0 else -1.0)
    tenth = spark.createDataFrame([("alpha",)], "w string").select(blake2b_tenth(F.col("w"))).first()[0]
    assert tenth == int.from_bytes(hashlib.blake2b(b"alpha", digest_size=2).digest(), "big") % 10


def test_sources_that_do_not_parse_are_told(spark):
    df = spark.createDataFrame([(1, "x = 1\n"), (2, "x = ("), (3, None)], "id long, s string")
    got = {(r["id"], r["feature"]): r["n"] for r in ast_features(df, "id", "s").collect()}
    assert got[(2, None)] == 0 and got[(1, "Assign")] == 1 and not any(k[0] == 3 for k in got)


def test_pairwise_weights_by_hand(spark):
    pairs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "k long, diff array<double>")
    # rate 0.5, margin 1: epoch 1 moves both; in epoch 2 the first scores 0.5 and moves, the second scores 2 and stays; in
    # epoch 3 the first scores exactly the margin, which does not exceed it
    assert fit_pairwise(pairs, "k", ["a", "b"], 1, 0.5) == {"a": 0.5, "b": 1.0}
    assert fit_pairwise(pairs, "k", ["a", "b"], 2, 0.5) == {"a": 1.0, "b": 1.0}
    assert fit_pairwise(pairs, "k", ["a", "b"], 3, 0.5) == {"a": 1.5, "b": 1.0}
    assert fit_pairwise(pairs.where("false"), "k", ["a", "b"]) == {}


def test_perceptron_is_the_plain_one(spark):
    rows = [(i, t.split(), y) for i, (t, y) in enumerate([("a b", "p"), ("b c", "q"), ("c d", "r"), ("a a d", "p"), ("e", "q"), ("", "r"), ("b", "p")])]
    w: dict = {y: {} for y in "pqr"}
    for _ in range(4):
        for _, t, y in rows:
            t = list(dict.fromkeys(t))
            guess = max("pqr", key=lambda c: (sum(w[c].get(x, 0.0) for x in t), c))
            if guess != y:
                for x in t:
                    w[y][x] = w[y].get(x, 0.0) + 1
                    w[guess][x] = w[guess].get(x, 0.0) - 1
    df = spark.createDataFrame(rows, "k long, t array<string>, y string")
    got = fit_perceptron(df, "k", F.col("t"), F.col("y"), 4)
    assert {(r[0], r[1]): r[2] for r in got.collect()} == {(y, x): v for y in w for x, v in w[y].items() if v}
    want = {k: max((c for c in "pqr" if any(w[c].values())), key=lambda c: (sum(w[c].get(x, 0.0) for x in set(t)), c)) for k, t, _ in rows}
    assert {r[0]: r[1] for r in predict(got, df, "k", F.col("t")).collect()} == want


@pytest.mark.parametrize("fraction", [0.0, 0.3, 1.0])
def test_neither_side_of_a_split_is_empty(spark, fraction):
    keys = spark.createDataFrame([(x,) for x in ["a", "b", "c", "d", "e", None, "a"]], "key string")
    got = {r["key"]: r for r in group_split(keys, "s", fraction).collect()}
    fractions = {k: int(hashlib.sha256(f"s:{k}".encode()).hexdigest()[:16], 16) / 2**64 for k in "abcde"}
    want = {k for k in fractions if fractions[k] < fraction}
    want = want or {"a"}
    want = want - {"e"} if len(want) == 5 else want
    assert {k for k in got if got[k]["validation"]} == want and {k for k in got if got[k]["train"]} == set("abcde") - want
    alone = group_split(keys.where("key = 'b'"), "s", fraction).first()
    assert alone["validation"] and alone["train"] and not alone["held_out"]
    assert group_split(keys.where("false"), "s", fraction).count() == 0


def test_predictors_and_strategies_can_be_passed_in(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0), (3, "b", None)], "id long, x string, y double")
    accuracy, misses = evaluate_predictions(rows, "id", {"x": F.col("x"), "y": F.col("y")}, lambda d: d.where("id < 3").select("id", F.lit("a").alias("x")))
    assert {tuple(r) for r in accuracy.collect()} == {("x", 3, 1, round(1 / 3, 6)), ("y", 3, 1, round(1 / 3, 6)), ("(row)", 3, 0, 0.0)}
    assert {tuple(r) for r in misses.collect()} == {(1, "y", "1.0", None), (2, "x", None, "a"), (2, "y", "2.0", None), (3, "x", "b", None)}
    ranked = ranked_by(rows, ["x"], {"up": [F.asc("id")], "down": [F.desc("id")]}, 1)
    assert ranked.count() == 6 and math.isclose(ranked.agg(F.sum("place")).first()[0], 6) and json.dumps(ranked.columns)
