import difflib
import hashlib
import random
import re

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarrymint.operators import duplicates
from quarrymint.operators.duplicates import near_duplicates


def brute(rows, overlap, ratio):
    classes = {}
    for k, t, s in rows:
        if t is not None and s is not None:
            norm = re.sub(r"\s+", " ", t.lower()).strip()
            classes.setdefault((norm, s), set()).add(k)
    out = set()
    for (a, s), ka in classes.items():
        for (b, u), kb in classes.items():
            x, y = (set(re.findall(r"\*\*|\^|[a-z0-9_]+", v)) for v in (a, b))
            if s < u and x and y and len(x & y) / len(x | y) >= overlap:
                first, second = ((a, s, ka), (b, u, kb)) if (a, s) <= (b, u) and a <= b else ((b, u, kb), (a, s, ka))
                r = difflib.SequenceMatcher(None, first[0], second[0]).ratio()
                if r >= ratio:
                    out.add((frozenset([(min(first[2]), first[1]), (min(second[2]), second[1])]), round(r, 4)))
    return out


def run(spark, rows, **k):
    df = spark.createDataFrame(rows, "id long, t string, s string").withColumn("h", F.lit(1)).withColumn("norm", F.lit(2))
    got = near_duplicates(df, "id", "t", F.col("s"), **k).collect()
    assert len(got) == len({(r["left"], r["right"], r["left_side"], r["right_side"]) for r in got})
    return {(frozenset([(r["left"], r["left_side"]), (r["right"], r["right_side"])]), r["similarity"]) for r in got}


def test_matches_brute_force(spark):
    rnd = random.Random(1)
    base = ["fix the parser of nested records", "add a retry to the client", "a b", "rename the helper that loads tables from disk"]
    rows = []
    for i in range(150):
        w = rnd.choice(base).split()
        if rnd.random() < 0.6:
            w[rnd.randrange(len(w))] = rnd.choice(["x", "records", "client2", "the"])
        rows.append((i, "  ".join(w).upper() if i % 7 == 0 else " ".join(w), rnd.choice(["train", "test", "validation", None])))
    rows += [(200, None, "train"), (201, "", "test"), (202, "!!", "train"), (203, "!!", "test")] + rows[:5]
    assert run(spark, rows) == brute(rows, 0.45, 0.88)
    assert run(spark, []) == set()


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_matches_brute_force_on_the_tasks(spark, folder):
    t = pq.read_table(f"/root/testdata/{folder}/tasks.parquet", columns=["task_id", "prompt", "split"]).to_pylist()
    rows = [(r["task_id"], r["prompt"], {"train": "train", "test": "test"}.get((r["split"] or "").strip().lower())) for r in t]
    assert run(spark, rows) == brute(rows, 0.45, 0.88)


def made(n, seed, sides=("train", "test", "validation")):
    """Texts of a few sentences over common words, each with rare names; some are copied with small changes."""
    rnd = random.Random(seed)
    forms = ["let {} accept a keyword for the {} and default it to {}", "make {} skip the {} and count {} of them", "pass the {} through to {} before limit {} closes", "guard {} against a missing {} and log line {}"]
    nouns = [f"{a}{b}" for a in ("bo", "ca", "pil", "tra", "wi") for b in ("bbin", "nyon", "lar", "ssel", "nch", "ter")]
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.1:
            t = rnd.choice(rows)[1].split()
            t[rnd.randrange(len(t))] = rnd.choice(nouns)
            rows.append((i, " ".join(t), rnd.choice(sides)))
        else:
            parts = [f.format(*(rnd.choice(nouns) if rnd.random() < 0.6 else f"{rnd.choice(nouns)}_{rnd.choice(nouns)}" for _ in range(2)), rnd.randrange(4000)) for f in rnd.choices(forms, k=rnd.randint(1, 5))]
            rows.append((i, ". ".join(parts), rnd.choice(sides)))
    return rows


def test_disk_does_not_follow_the_pairs_of_texts_with_common_words(spark):
    rows = made(3000, 2)
    size = sum(len(t) for _, t, _ in rows)

    def written():
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    began = written()
    assert run(spark, rows)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert written() - began < 4 * size


@pytest.mark.parametrize("small", [1 / 64, 2])  # 2: all sides are put together
def test_matches_brute_force_over_many_blocks(spark, monkeypatch, small):
    monkeypatch.setattr(duplicates, "LEAST_BLOCK", 16)
    monkeypatch.setattr(duplicates, "EXACT_CHARS", 100)
    monkeypatch.setattr(duplicates, "SMALL_SIDE", small)
    rows = made(300, 3, ("train", "test", "validation", "other"))
    rows += [(1000 + i, f"same length {i:02d}", "train") for i in range(40)] + [(2000 + i, f"same length {i:02d}", "test") for i in range(40)]
    long = " ".join(made(60, 4)[i][1] for i in range(60))
    rows += [(3000, long, "train"), (3001, long.replace("keyword", "key", 3), "test"), (3002, long + " é𝄞é𝄞", "other")]
    want = brute(rows, 0.45, 0.88)
    assert len(want) > 50
    assert run(spark, rows) == want


def test_lengths_of_buckets_hold_their_lengths(spark):
    for r in spark.range(0, 20_000, 7).select("id", duplicates._length_bucket(F.col("id")).alias("b")).collect():
        low, high = duplicates._span(r["b"])
        assert low <= r["id"] <= high


def test_bound_on_common_subsequences():
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abcé𝄞 ") for _ in range(rnd.choice([1, 5, 63, 64, 65, 130, 200]))) for _ in range(40)]
    norm = pd.DataFrame({"id": range(40), "side": ["s"] * 40, "norm": texts, "words": [[1]] * 40, "block": [0] * 40, "chars": [len(t) for t in texts]})
    order = np.arange(duplicates.WORD_BUCKETS, dtype=np.uint32)
    block = duplicates._Block(next(duplicates._packed(order, {"s": 0})(iter([norm]))))
    assert block.text == texts
    i, j = (v.ravel() for v in np.meshgrid(np.arange(40), np.arange(40)))
    got = duplicates.common_subsequences(block, block, i, j)
    for a, b, n in zip(i, j, got, strict=True):
        row = [0] * (len(texts[b]) + 1)
        for c in texts[a]:
            last = 0
            for k, d in enumerate(texts[b], 1):
                last, row[k] = row[k], last + 1 if c == d else max(row[k], row[k - 1])
        assert n == row[-1] == duplicates._subsequence(texts[a], texts[b])


@pytest.mark.parametrize("gather", [0, 1 << 40])  # words are looked up, all pairs are compared
def test_bounds_keep_what_overlaps(monkeypatch, gather):
    monkeypatch.setattr(duplicates, "GATHER", gather)
    norm = [t for _, t, _ in made(400, 6)]
    sets = [set(re.findall(r"[a-z0-9_]+", t)) for t in norm]
    rows = pd.DataFrame({"id": range(400), "side": ["s", "t"] * 200, "norm": norm, "block": [0, 1] * 200, "chars": [len(t) for t in norm]})
    rows["words"] = [[int.from_bytes(hashlib.sha1(w.encode()).digest()[:8], "little", signed=True) for w in s] for s in sets]
    packed = next(duplicates._packed(np.arange(duplicates.WORD_BUCKETS, dtype=np.uint32), {"s": 0, "t": 1})(iter([rows])))
    x, y = (duplicates._Block(packed[packed["block"] == b]) for b in (0, 1))
    i, j = duplicates._outer(x, y, 0.45, 0.88)
    i, j = i[(ok := duplicates._may_align(x, y, i, j, 0.88))], j[ok]
    got = set(zip(x.id[i].tolist(), y.id[j].tolist(), strict=True))
    want = {(a, b) for a in range(0, 400, 2) for b in range(1, 400, 2) if len(sets[a] & sets[b]) >= 0.45 * len(sets[a] | sets[b]) and difflib.SequenceMatcher(None, norm[a], norm[b]).ratio() >= 0.88}
    assert want and want <= got
