"""Filling fixed-capacity containers: shortest-pack-first over the histogram of lengths (problem 7)."""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymint.session import checked_broadcast, cut

#: Hash buckets into which the items of one length are dealt to be numbered; a hot length is shared by that many tasks.
BUCKETS = 256


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, Counter]]:
    """Packing patterns (count, lengths) that hold every item of the histogram, lengths placed longest first.

    Each step takes the group of packs with the fewest tokens so far; if the length fits there, as many of those packs
    as there are items left get one, else new packs are opened. Cost follows the number of patterns, not of items."""
    heap: list[tuple[int, int, int, Counter]] = []  # tokens so far, tie-break, count, lengths
    serial = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        done = []
        while left:
            if heap and heap[0][0] + length <= capacity:
                used, _, count, lengths = heapq.heappop(heap)
                fit = 1
                if count <= left:  # several rounds over the same packs at once, as long as they stay the shortest
                    fit = max(1, min((capacity - used) // length, left // count, ((heap[0][0] - used) // length) if heap else left // count))
                took = min(count, left) if fit == 1 else count
                if took < count:
                    serial += 1
                    heapq.heappush(heap, (used, serial, count - took, lengths))
                grown = Counter(lengths)
                grown[length] += fit
                serial += 1
                heapq.heappush(heap, (used + fit * length, serial, took, grown))
                left -= took * fit
            else:
                each = min(left, max(1, capacity // length))
                packs = left // each
                serial += 1
                done.append((length * each, serial, packs, Counter({length: each})))
                left -= packs * each
        for d in done:
            heapq.heappush(heap, d)
    return [(count, lengths) for _, _, count, lengths in sorted(heap, key=lambda x: (-x[0], x[1]))]


def numbered(df: DataFrame, group: str, order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``df`` with ``rank`` from 0 within each group, without sending a group to one task: the rows of a (group, hash
    bucket) are numbered and moved by the sum of the buckets before."""
    salted = df.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = salted.groupBy(group, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(group, "__b").orderBy(*order)
    return (
        salted.withColumn("__r", F.row_number().over(inside) - 1)
        .join(offsets, [group, "__b"])
        .withColumn("rank", (F.col("__off") + F.col("__r")).cast("long"))
        .drop("__b", "__r", "__off")
    )


def pieces(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """Every item as one piece, or, above the capacity, as full pieces and a rest."""
    n = F.col(size)
    count = F.greatest(F.lit(1), F.ceil(n / F.lit(capacity))).cast("int")
    return (
        sizes.withColumn("piece_no", F.explode(F.sequence(F.lit(1), count)))
        .withColumn("token_start", ((F.col("piece_no") - 1) * F.lit(capacity)).cast("long"))
        .withColumn("piece_tokens", F.least(F.lit(capacity), n - F.col("token_start")).cast("long"))
        .withColumn("piece_no", F.col("piece_no").cast("long"))
    )


def pack(sizes: DataFrame, key: str, size: str, capacity: int, buckets: int = BUCKETS) -> DataFrame:
    """``key``, piece_no, token_start, piece_tokens and container_id of every item of ``sizes`` (key, size).

    Only items above the capacity are split, into full containers and a rest that is packed like any item. A null or
    zero size takes no room: the item comes out whole, with a null container. Repeated rows are items of their own. The
    histogram (at most ``capacity`` rows) is all that the driver sees; containers come back by (length, rank) ranges.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    base = sizes.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("long").alias("n"))
    all_pieces = cut(pieces(base, "k", "n", capacity).drop("n"), "packing-pieces")
    placed = all_pieces.where(F.col("piece_tokens") > 0)
    histogram = {r[0]: r[1] for r in placed.groupBy("piece_tokens").count().collect()}
    next_rank: dict[int, int] = defaultdict(int)
    segments, container = [], 0
    for count, lengths in shortest_pack_first(histogram, capacity):
        for length, times in sorted(lengths.items()):
            segments.append((length, next_rank[length], next_rank[length] + count * times, container, times))
            next_rank[length] += count * times
        container += count
    spark = sizes.sparkSession
    seg = spark.createDataFrame(segments, "piece_tokens long, lo long, hi long, base long, times long")
    by_length = seg.groupBy("piece_tokens").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "base", "times"))).alias("segs"))
    by_length = checked_broadcast(by_length, len(segments), 48)
    ranked = numbered(placed, "piece_tokens", ["k", "piece_no"], buckets)
    hit = F.filter("segs", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") < s["hi"]))[0]
    out = (
        ranked.join(by_length, "piece_tokens")
        .withColumn("s", hit)
        .withColumn("container_id", (F.col("s.base") + F.floor((F.col("rank") - F.col("s.lo")) / F.col("s.times"))).cast("long"))
    )
    cols = ["k", "piece_no", "token_start", "piece_tokens", "container_id"]
    empty = all_pieces.where(F.col("piece_tokens") <= 0).withColumn("container_id", F.lit(None).cast("long"))
    name = key if key not in cols[1:] else f"{key}_"
    return out.select(*cols).unionByName(empty.select(*cols)).withColumnRenamed("k", name)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, the least number that could do, tokens, and the share of the containers' room in use."""
    per = packed.where(F.col("container_id").isNotNull()).groupBy("container_id").agg(F.sum("piece_tokens").alias("t"))
    total = per.agg(F.count("*").alias("containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.max("t").alias("fullest"))
    return total.select(
        "containers",
        F.ceil(F.col("tokens") / F.lit(capacity)).cast("long").alias("least_containers"),
        "tokens",
        "fullest",
        F.round(F.try_divide(F.col("tokens").cast("double"), F.col("containers") * F.lit(capacity)), 6).alias("fill"),
    )
