import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymint.llm.chunking import KINDS, MIN_FILL, boundaries, greedy_cuts, split_oversized, split_text
from quarrymint.llm.tokens import encoder, token_counts

TEXT = "\n\n".join(" ".join(f"Sentence {i} of {j} says naïve things about 漢字 and code_{i}." for i in range(12)) for j in range(20))


def brute_cuts(kind, limit, overlap):
    n, cuts = len(kind) - 1, [0]
    while cuts[-1] != n:
        c = cuts[-1]
        start = max(c - overlap, 0)
        while kind[start] == 9:
            start -= 1
        if n - start <= limit:
            cuts.append(n)
            continue
        for k in range(5):
            least = start + (0 if k == 4 else MIN_FILL * limit)
            fits = [p for p in range(c + 1, start + limit + 1) if kind[p] <= k and p >= least]
            if fits:
                cuts.append(fits[-1])
                break
        else:
            cuts.append(next(p for p in range(c + 1, n + 1) if kind[p] != 9))
    return cuts


@pytest.mark.parametrize("seed", range(8))
def test_doubling_equals_greedy(seed):
    rnd = random.Random(seed)
    kind = np.array([0] + [rnd.choice([0, 1, 2, 3, 3, 3, 4, 4, 4, 9]) for _ in range(500)] + [0], dtype=np.int8)
    starts, ends = greedy_cuts(kind, 40, 6)
    want = brute_cuts(kind, 40, 6)
    assert ends.tolist() == want[1:]
    assert all(kind[s] != 9 for s in starts)


@pytest.mark.parametrize("text", [TEXT, TEXT.replace("\n\n", " ").replace(".", ""), "a" * 5000, "漢字" * 2000, "é\n" * 3000, " " * 4000 + "x", "🙂" * 1500], ids=range(7))
def test_round_trip_limit_and_overlap(text):
    e = encoder()
    limit, overlap = 100, 16
    pieces = split_text(text, limit, overlap)
    at = 0
    for i, (piece, lo, hi, n, shared, cut) in enumerate(pieces):
        assert text[lo:hi] == piece and n == len(e.encode_ordinary(piece)) <= limit and cut in KINDS
        assert lo <= at < hi
        assert (shared == 0) == (i == 0) or shared > 0
        at = hi
    assert at == len(text) and pieces[-1][5] == "end"


def test_natural_boundaries_are_used():
    assert {p[5] for p in split_text(TEXT, 300, 20)} <= {"paragraph", "line", "sentence", "end"}


def test_operator(spark):
    rows = [(1, None), (2, ""), (3, "short"), (4, TEXT), (4, TEXT), (5, "word " * 99), (6, "word " * 200)]
    df = spark.createDataFrame(rows, "piece long, t string").withColumn("k", F.lit(1)).withColumn("n_tokens", F.lit(1))
    got = split_oversized(df, "piece", "t", 100, 10).collect()
    assert {r["piece_"] for r in got} == {4, 6}
    assert len({(r["piece_no"], r["start_char"]) for r in got if r["piece_"] == 4}) * 2 == sum(r["piece_"] == 4 for r in got)
    assert split_oversized(df.where("false"), "piece", "t").count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Hello world"), (4, TEXT)], "id long, t string")
    e = encoder()
    assert {r["id"]: r["n_tokens"] for r in token_counts(df, "id", "t").collect()} == {1: 0, 2: 0, 3: 2, 4: len(e.encode_ordinary(TEXT))}


def test_boundary_kinds():
    raw = np.frombuffer("a. b\n\nc é".encode(), dtype=np.uint8)
    at = np.arange(len(raw) + 1)
    # before: the full stop, the space after it, b, the first and the second line break, c
    assert boundaries(raw, at).tolist()[1:7] == [4, 2, 2, 3, 1, 0]
    assert boundaries(raw, at)[9] == 9


@pytest.mark.parametrize("limit, overlap", [(31, 0), (100, 51), (100, -1)])
def test_limits_that_cannot_be_kept_are_refused(spark, limit, overlap):
    with pytest.raises(ValueError):
        split_oversized(spark.createDataFrame([], "id long, t string"), "id", "t", limit, overlap)
