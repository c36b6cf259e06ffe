import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarrymint.llm.mixing import mix
from quarrymint.llm.packing import fill_report, pack, shortest_pack_first


def run(spark, rows, capacity):
    df = spark.createDataFrame(rows, "id string, size long").withColumn("container_id", F.lit(7)).withColumn("rank", F.lit(7))
    return pack(df, "id", "size", capacity, 8)


def check(rows, got, capacity):
    per, pieces = Counter(), {}
    for r in got:
        if r["container_id"] is None:
            assert r["piece_tokens"] <= 0
            continue
        assert 0 < r["piece_tokens"] <= capacity
        per[r["container_id"]] += r["piece_tokens"]
        pieces.setdefault(r["id"], []).append((r["piece_no"], r["token_start"], r["piece_tokens"]))
    assert all(v <= capacity for v in per.values())
    assert not per or set(per) == set(range(len(per)))
    for i, n in Counter(i for i, _ in rows).items():
        size = dict(rows)[i]
        mine = sorted(pieces.get(i, []))
        assert sum(p[2] for p in mine) == n * (size or 0)
        if size and size <= capacity:
            assert [p[2] for p in mine] == [size] * n  # never split
    return len(per)


@pytest.mark.parametrize("capacity", [10, 64])
def test_whole_items_within_capacity(spark, capacity):
    rnd = random.Random(capacity)
    rows = [(f"d{i}", rnd.choice([None, 0, 1, 3, 3, 3, rnd.randrange(1, capacity), capacity, capacity + 1, capacity * 5 // 2])) for i in range(400)]
    got = run(spark, rows, capacity).collect()
    assert {r["id"] for r in got} == {i for i, _ in rows}
    used = check(rows, got, capacity)
    least = -(-sum(s or 0 for _, s in rows) // capacity)
    assert used <= least * 1.12 + 1
    report = fill_report(run(spark, rows, capacity), capacity).first()
    assert (report["containers"], report["least_containers"]) == (used, least) and report["fullest"] <= capacity


def test_repeated_rows_hot_length_and_empty(spark):
    rows = [("same", 5)] * 7 + [(f"h{i}", 4) for i in range(200)]
    check(rows, run(spark, rows, 12).collect(), 12)
    assert run(spark, [], 12).count() == 0
    assert fill_report(run(spark, [], 12), 12).first()["containers"] == 0
    with pytest.raises(ValueError):
        run(spark, [], 0)


@pytest.mark.parametrize("seed", range(6))
def test_patterns_hold_every_item(seed):
    rnd = random.Random(seed)
    histogram = {rnd.randrange(1, 100): rnd.randrange(1, 5000) for _ in range(rnd.randrange(1, 60))}
    patterns = shortest_pack_first(histogram, 100)
    held = Counter()
    for count, lengths in patterns:
        assert count > 0 and sum(n * k for n, k in lengths.items()) <= 100
        for n, k in lengths.items():
            held[n] += k * count
    assert held == Counter(histogram)


TARGETS = [("big", 0.5, 1), ("Small Source", 0.4, 3), ("none", 0.1, 4)]


def mixture(spark, rows, targets=TARGETS, total=None):
    df = spark.createDataFrame(rows, "id long, source string, size long").withColumn("copy_no", F.lit(1)).withColumn("h", F.lit(1))
    out, report = mix(df, "id", "source", "size", spark.createDataFrame(targets, "source string, target_share double, max_repeats long"), total)
    return out.collect(), {r["source"]: r for r in report.collect()}


def data(n):
    rnd = random.Random(3)
    return [(i, "big" if i % 10 else rnd.choice(["small-source", "SMALL_SOURCE ", None, "", "unlisted"]), rnd.choice([None, 0, 5, 20, 50])) for i in range(n)]


def test_shares_and_repeats(spark):
    rows = data(4000)
    got, report = mixture(spark, rows, total=20_000)
    tokens, copies = Counter(), Counter()
    for r in got:
        tokens[r["source"]] += r["n_tokens"]
        copies[r["id"]] += 1
    size = {i: s or 0 for i, _, s in rows}
    assert all(r["n_tokens"] == size[r["id"]] for r in got)
    assert set(tokens) <= {"big", "small_source"}
    assert abs(tokens["big"] - 10_000) <= 50
    listed = sum(s or 0 for _, src, s in rows if src in ("small-source", "SMALL_SOURCE "))
    want = min(8_000, 3 * listed)
    assert abs(tokens["small_source"] - want) <= 3 * 50 and max(copies.values()) <= 3
    assert report["big"]["mixed_tokens"] == tokens["big"] and report["none"]["mixed_tokens"] == 0
    assert report[None]["available_docs"] == sum(src in (None, "", "unlisted") for _, src, _ in rows)
    assert abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-4


def test_thresholds_nest(spark):
    rows = data(1500)
    small = Counter((r["id"], r["copy_no"]) for r in mixture(spark, rows, total=4_000)[0])
    large = Counter((r["id"], r["copy_no"]) for r in mixture(spark, rows, total=9_000)[0])
    assert small <= large


def test_empty_tables(spark):
    assert mixture(spark, [])[0] == []
    got, report = mixture(spark, data(20), [])
    assert got == [] and set(report) == {None}


def test_targets_of_one_source_are_one_target(spark):
    rows = data(2000)
    one = mixture(spark, rows, [("big", 0.5, 1), ("small source", 0.5, 2)], 5_000)
    two = mixture(spark, rows, [("big", 0.5, 1), ("small source", 0.2, 1), ("SMALL-SOURCE", 0.3, 2)], 5_000)
    assert Counter(one[0]) == Counter(two[0]) and one[1]["small_source"]["mixed_tokens"] == two[1]["small_source"]["mixed_tokens"]


def test_the_histogram_stays_small_for_many_sources(spark, monkeypatch):
    import quarrymint.llm.mixing as mixing

    assert [mixing.level_bits(n) for n in (1, 9, 256, 257, 100_000)] == [12, 12, 12, 10, 3]
    rows = data(1500)
    want = mixture(spark, rows, total=9_000)[0]
    monkeypatch.setattr(mixing, "MOST_CELLS", 64)
    got = mixture(spark, rows, total=9_000)[0]
    assert Counter(got) == Counter(want)
