import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from quarrymint.operators.transitions import examples, predicted, ranked
from quarrymint.plans import registry

SCHEMA = """id string, source_outcome struct<record_kind:string>, prompt_context struct<embedding:array<double>>,
structured_action struct<kind:string,repo_mode:string,task_type:string,features:array<string>,target_files:array<string>>,
outcome struct<kind:string,status:string,failure_kind:string>, validation struct<status:string>,
repo_before struct<state:struct<repo_embedding:array<double>>>, repo_after struct<state:struct<repo_embedding:array<double>>>,
ingested_at long"""


def made(seed, n=40):
    """Transitions of two prompt lengths; some are blocked, some have no input; action z comes once."""
    rnd = random.Random(seed)
    vec = lambda n: [rnd.uniform(-1, 1) for _ in range(n)]
    rows = []
    for i in range(n):
        kind = rnd.choice(["source_changed", "source_changed", "source_unchanged", "blocked", None])
        after = vec(3) if kind and kind.startswith("source") else None
        action = "z" if i == 20 else rnd.choice("ab")
        kind, after = ("source_changed", vec(3)) if i == 20 else (kind, after)
        prompt = None if i == 7 else vec(rnd.choice([4, 6]))
        rows.append((f"t-{i:04}", (rnd.choice(["p", None]),), (prompt,), (action, "m", None, ["f", "f"], None), (kind, rnd.choice(["ok", "bad"]), None), (rnd.choice(["passed", "failed", None]),), ((vec(3),),), ((after,),) if after else None, i))
    return rows


def hashed(row, dim=64):
    names = (("source", row[1], ["record_kind"]), ("action", row[3], ["kind", "repo_mode", "task_type"]), ("outcome", row[4], ["kind", "status", "failure_kind"]), ("validation", row[5], ["status"]))
    feats = [f"{p}:{f}:{x}" for p, v, fs in names for f, x in zip(fs, v) if x]  # noqa: B905
    feats += [f"action:features:{x}" for x in row[3][3] or []] + [f"action:target_files:{x}" for x in row[3][4] or []]
    out = [0.0] * dim
    for f in feats:
        d = hashlib.sha256(f.encode()).digest()
        out[int.from_bytes(d[:8], "big") % dim] += 1.0 if d[8] % 2 == 0 else -1.0
    return unit(out)


def unit(v):
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True)) if len(a) == len(b) else None


class Oracle:
    def __init__(self, rows):
        self.rows = {r[0]: r for r in rows}
        self.input = {r[0]: r[2][0] and unit([0.44 * x for x in r[2][0]] + [0.44 * x for x in r[6][0][0]] + [0.12 * x for x in hashed(r)]) for r in rows}
        self.delta = {r[0]: [b - a for a, b in zip(r[6][0][0], r[7][0][0], strict=True)] for r in rows if r[7]}

    def near(self, q, vectors, k):
        found = [(round(dot(vectors[q], v), 6), i) for i, v in vectors.items() if i != q and v and vectors[q] and self.input[i] and len(v) == len(vectors[q])]
        return [i for _, i in sorted(found, reverse=True)[:k]]

    def predict(self, q, nearest, leave_out):
        if nearest is None or nearest not in self.delta:
            return None
        pool = {i: d for i, d in self.delta.items() if not (leave_out and i == q)}
        some = [d for i, d in pool.items() if self.rows[i][3][0] == self.rows[q][3][0]]
        use = some or list(pool.values())
        return [a + sum(d[i] for d in use) / len(use) for i, a in enumerate(self.rows[q][6][0][0])], "action_conditioned_average" if some else "global_average"


@pytest.mark.parametrize("leave_out", [False, True])
def test_predictions_equal_brute_force(spark, leave_out):
    rows = made(5)
    o = Oracle(rows)
    ex = examples(spark.createDataFrame(rows, SCHEMA))
    got = {r["id"]: r for r in predicted(ex, ex, ranked(ex, ex, "input", 1), leave_out).collect()}
    assert set(got) == set(o.rows)
    kinds = set()
    for i, r in got.items():
        near = next(iter(o.near(i, o.input, 1)), None)
        want = o.predict(i, near, leave_out)
        assert r["nearest"] == near
        assert (r["target_kind"], r["outcome_kind"]) == ((None, None) if near is None else ("repo_after_embedding" if near in o.delta else "blocked_or_clarification", o.rows[near][4][0]))
        assert r["delta_kind"] == (want and want[1]) and (want is None) == (r["predicted"] is None)
        assert want is None or r["predicted"] == pytest.approx(want[0], abs=2e-6)
        kinds |= {r["target_kind"], r["delta_kind"]}
    assert {"repo_after_embedding", "blocked_or_clarification", "action_conditioned_average"} <= kinds


def test_m03_predicts_every_20th_transition(spark, tmp_path):
    rows = made(8, 60)
    o = Oracle(rows)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "prompt_repo_transitions.parquet"))
    got = {r["id"]: r["nearest"] for r in registry.queries()["m03_predictions"](spark, str(tmp_path)).collect()}
    assert got == {i: o.near(i, o.input, 1)[0] for i in ("t-0000", "t-0020", "t-0040")}


def test_evaluation_equals_brute_force(spark, tmp_path):
    rows = made(11, 61)
    o = Oracle(rows)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "prompt_repo_transitions.parquet"))
    got = {r["model"]: r for r in registry.queries()["m04_evaluation"](spark, str(tmp_path)).collect()}
    ids = ["t-0000", "t-0020", "t-0040", "t-0060"]
    prompts = {i: r[2][0] for i, r in o.rows.items()}
    expected = {i: (o.rows[i][4][0], o.rows[i][5][0]) for i in ids}
    residuals = []
    for model, vectors in (("v0", o.input), ("prompt_only", prompts)):
        near, dist = {i: o.near(i, vectors, 3) for i in ids}, []
        for i in ids:
            n = near[i][0]
            p = o.predict(i, n, True)[0] if model == "v0" and n in o.delta else o.rows[n][7][0][0] if n in o.delta else None
            d = math.dist(p, o.rows[i][7][0][0]) if p and i in o.delta else None
            dist += [d] if d is not None else []
            if model == "v0":
                miss = (o.rows[n][4][0], o.rows[n][5][0]) != expected[i]
                residuals += [(miss, -1.0 if d is None else round(d, 5), i)] if miss or d is not None else []
        r = got[model]
        for at, f, of in ((0, "outcome_kind", 4), (1, "validation_status", 5)):
            some = [i for i in ids if expected[i][at]]
            value = lambda n: o.rows[n][of][0]  # noqa: B023, E731
            assert (r["rows_"], r[f"{f}_total"]) == (len(ids), len(some))
            assert r[f"{f}_top_1"] == sum(value(near[i][0]) == expected[i][at] for i in some)
            assert r[f"{f}_top_3"] == sum(expected[i][at] in map(value, near[i]) for i in some)
        assert r["applicable"] == sum(i in o.delta for i in ids) and r["predicted"] == len(dist)
        assert not dist or r["mean_distance"] == pytest.approx(sum(dist) / len(dist), abs=1e-5)
    worst = registry.queries()["m04_residuals"](spark, str(tmp_path)).collect()
    assert {(r["is_residual"], -1.0 if r["distance"] is None else round(r["distance"], 5), r["id"]) for r in worst} == set(residuals)
    states = {i: r[7][0][0] for i, r in o.rows.items() if i in o.delta}
    for r in worst:
        if r["distance"] is not None:
            p = o.predict(r["id"], r["nearest"], True)[0]
            assert r["nearest_state"] == min((round(math.dist(p, v), 6), i) for i, v in states.items() if i != r["id"])[1]
