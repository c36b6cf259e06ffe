"""Same or almost the same texts across two sides, by an edit-distance segment join over word strings (problem 5).

A text is taken as the string of its distinct words in one global order, rare words first. For two such strings the
distance in insertions and deletions is the size of the symmetric difference of the word sets, so a similarity (common
words over all distinct words) of at least t is a distance of at most (n + m)(1 - t)/(1 + t) for n and m words.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymint.llm.tokens import small_batches
from quarrymint.session import cut, hot_values, join_hash, skew_join

#: Hash buckets of words whose document counts give the global order: bounds what is sent to every task.
WORD_BUCKETS = 1 << 16
#: Longs of a word bitmap; a differing word changes at most one bit, so bitmaps too far apart rule a pair out.
BITMAP = 4
#: Words whose segments or substrings are listed at once.
EMIT_WORDS = 1 << 15


def words(text: Column, pattern: str = "[a-z0-9_]+") -> Column:
    """Hashes of the distinct longest runs of a-z, 0-9 and _ after lower-casing."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)), lambda w: F.xxhash64(w)))


def most_edits(n: int, t: float) -> int:
    """Greatest distance from a string of ``n`` words to any string that is similar enough."""
    return int(n * (1 - t) / t + 1e-9)


@lru_cache(maxsize=4096)
def layout(n: int, t: float) -> np.ndarray:
    """(start, length) of the k + 1 segments of an evaluation string of ``n`` words, k its most edits.

    The first third of the segments are single words, the rarest; the others share the rest evenly, longer ones last,
    because frequent words select only in company."""
    k = most_edits(n, t)
    single = (k + 1) // 3
    base, extra = divmod(n - single, k + 1 - single)
    lengths = np.repeat([1, base, base + 1], [single, k + 1 - single - extra, extra]).astype(np.int64)
    return np.stack([np.cumsum(lengths) - lengths, lengths], axis=1)


def lengths_for(m: int, t: float) -> range:
    return range(max(1, int(np.ceil(m * t - 1e-9))), int(m / t + 1e-9) + 1)


#: Strings of more words give their substrings of the lengths in question at all places, found without trying each length.
LONG = 2048


@lru_cache(maxsize=4096)
def substrings(m: int, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(position, length) of every substring of a training string of ``m`` words that a segment of any evaluation string
    may match. With k edits at most and k + 1 segments, some segment i is untouched with exactly i edits before it, so it
    is moved by at most i places, and by at most k - i from the other end. Of a long string more places are given."""
    cover: dict[int, np.ndarray] = {}
    if m > LONG:
        ns = np.array(lengths_for(m, t), dtype=np.int64)
        ks = (ns * (1 - t) / t + 1e-9).astype(np.int64)
        base = (ns - (ks + 1) // 3) // (ks + 1 - (ks + 1) // 3)
        for length in {1, *base.tolist(), *(base + 1).tolist()}:
            if 0 < length <= m:
                cover[length] = np.arange(m + 2) <= m - length
        cover[1] = cover[1] & (np.arange(m + 2) <= 2 * int((ks.max() + 1) // 3)) if base.min() > 1 else cover[1]
    else:
        for n in lengths_for(m, t):
            k = most_edits(n, t)
            s, length = layout(n, t).T
            i = np.arange(len(s))
            lo = np.maximum(np.maximum(-i, m - n - (k - i)), -s)
            hi = np.minimum(np.minimum(i, m - n + (k - i)), m - length - s)
            for x in np.unique(length):
                of = (length == x) & (lo <= hi)
                steps = cover.setdefault(int(x), np.zeros(m + 2, dtype=np.int64))
                np.add.at(steps, (s + lo)[of], 1)
                np.add.at(steps, (s + hi)[of] + 1, -1)
        cover = {x: np.cumsum(steps) > 0 for x, steps in cover.items()}
    places = [(np.flatnonzero(on), x) for x, on in sorted(cover.items())]
    pos = np.concatenate([p for p, _ in places]) if places else np.zeros(0, dtype=np.int64)
    return pos.astype(np.int64), np.repeat(np.array([x for _, x in places], dtype=np.int64), [len(p) for p, _ in places])


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64


@lru_cache(maxsize=64)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse, modulo 2^64."""
    with np.errstate(over="ignore"):
        up, down = (np.cumprod(np.array([1] + [b] * (n - 1), dtype=np.uint64)) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return up, down


def segment_keys(seq: np.ndarray, pos: np.ndarray, ln: np.ndarray) -> np.ndarray:
    """One hash for each substring, by differences of a rolling sum; the same words in the same order hash the same."""
    with np.errstate(over="ignore"):
        h = seq.astype(np.uint64)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        up, down = _powers(1 << int(np.ceil(np.log2(len(h) + 2))))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])])
        out = (total[pos + ln] - total[pos]) * down[pos]  # the inverse power makes it independent of the position
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return out.view(np.int64) ^ (ln << 56)


def banded_distance(xs: list[np.ndarray], ys: list[np.ndarray], t: float) -> np.ndarray:
    """Insertions and deletions between the strings of each pair, by dynamic programming over the diagonals that a pair
    within its limit can use; beyond the limit any larger number. All pairs go together, one antidiagonal a step."""
    n = np.array([len(x) for x in xs])
    m = np.array([len(y) for y in ys])
    k = int(((n + m) * (1 - t) / (1 + t) + 1e-9).max())
    b, big = len(xs), 1 << 20
    x = np.full((b, n.max() + 2 * k + 3), -1, dtype=np.int64)
    y = np.full((b, m.max() + 2 * k + 3), -2, dtype=np.int64)
    x_known = np.zeros(x.shape, dtype=bool)
    for r in range(b):
        x[r, : n[r]], y[r, : m[r]], x_known[r, : n[r]] = xs[r], ys[r], True
    v = np.full((b, 2 * k + 3), big, dtype=np.int32)  # diagonal d = j - i at column d + k + 1
    v[:, k + 1] = 0
    out = np.full(b, big, dtype=np.int64)
    last = n + m
    diag = m - n
    inside = np.abs(diag) <= k
    for s in range(1, int(last.max()) + 1):
        d = np.arange(-k + ((s + k) & 1), k + 1, 2)
        d = d[(np.abs(d) <= s)]
        if len(d):
            i = (s - d) // 2
            j = (s + d) // 2
            c = d + k + 1
            step = np.minimum(v[:, c - 1], v[:, c + 1]) + 1
            both = (i > 0) & (j > 0)
            ii, jj = np.minimum(np.maximum(i - 1, 0), x.shape[1] - 1), np.minimum(np.maximum(j - 1, 0), y.shape[1] - 1)
            same = both & x_known[:, ii] & (x[:, ii] == y[:, jj])
            v[:, c] = np.where(same, v[:, c], step)
        done = np.flatnonzero((last == s) & inside)
        out[done] = v[done, diag[done] + k + 1]
    return out


def _ordered_classes(classes: DataFrame, counts: np.ndarray) -> DataFrame:
    def order(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            seqs, maps = [], []
            for h in part["words"]:
                h = np.asarray(h, dtype=np.int64)
                h = h[np.lexsort((h, counts[h & (WORD_BUCKETS - 1)]))]
                seqs.append(h)
                bits = (h.view(np.uint64) >> np.uint64(17)) % np.uint64(64 * BITMAP)
                row = np.zeros(BITMAP, dtype=np.uint64)
                np.bitwise_or.at(row, (bits >> np.uint64(6)).astype(int), np.uint64(1) << (bits & np.uint64(63)))
                maps.append(row.view(np.int64))
            yield pd.DataFrame({"c": part["c"], "left": part["left"], "right": part["right"], "n": [len(s) for s in seqs], "seq": seqs, "bits": maps})

    return small_batches(classes).mapInPandas(order, "c string, left boolean, right boolean, n int, seq array<long>, bits array<long>")


def similar_across(df: DataFrame, key: str, text: str, side: Column, t: float = 0.75, carry: Mapping[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs of similar texts from the two sides of ``side`` ('train' or 'eval'; anything else takes no part).

    Returns ``pairs`` (c_eval, c_train, common, distinct_words) between classes of texts with the same words, a class
    paired with itself where both sides have it, and ``members`` (c, key, side, and the ``carry`` columns). A text without
    words, or null, is in no class. Rows with one key on one side count once. The similarity is exact; nothing is capped or
    sampled. Words are compared by 64-bit hashes, classes by 128 bits.

    Method: classes first, so copies cost one row; words ordered by document counts over all classes (hashed to a table
    of bounded size; any order is right, this one is fast). Evaluation strings are cut into k + 1 segments, training
    strings give their substrings at the positions those can match, and both meet in an equi-join on the segment's hash.
    Position, length and a word bitmap thin the matches out inside the join; what is left is verified by banded dynamic
    programming. All joins are by shuffle; segments that the substrings of every 64th training class show to be hot, and
    classes in very many matches, are spread over several tasks.
    """
    if not 0.5 < t <= 1:
        raise ValueError("the similarity must be above 0.5")
    extra = [c.alias(name) for name, c in (carry or {}).items()]
    base = df.select(F.col(f"`{key}`").alias("id"), side.alias("side"), words(F.col(f"`{text}`")).alias("w"), *extra).where(F.col("side").isin("train", "eval") & (F.size("w") > 0))
    ordered = F.array_sort("w")
    c = F.concat(F.hex(F.xxhash64(ordered)), F.lit("-"), F.hex(F.xxhash64(ordered, F.lit(9))))
    base = cut(base.withColumn("c", c), "overlap-words")
    members = base.select("c", "id", "side", *(carry or {})).distinct()
    classes = base.groupBy("c").agg(F.bool_or(F.col("side") == "eval").alias("left"), F.bool_or(F.col("side") == "train").alias("right"), F.first("w").alias("words"))
    classes = cut(classes, "overlap-classes")
    buckets = classes.select(F.explode("words").alias("h")).groupBy(F.col("h").bitwiseAND(WORD_BUCKETS - 1).alias("b")).agg(F.count("*").alias("n"))
    counts = np.zeros(WORD_BUCKETS, dtype=np.int64)
    for r in buckets.collect():  # at most WORD_BUCKETS rows
        counts[r["b"]] = r["n"]
    # a class goes by 64 bits until it is verified: what has the same number is verified too
    table = cut(_ordered_classes(classes, counts).withColumn("h", F.xxhash64("c")), "overlap-strings")

    def emit(left: bool):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                lo, size = 0, np.cumsum(part["n"].to_numpy())
                while lo < len(part):  # some words at a time: long texts have many substrings
                    hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + EMIT_WORDS)))
                    yield _emitted(part.iloc[lo:hi], left, t)
                    lo = hi

        return run

    shape = "s long, h long, n int, p int, i int, " + ", ".join(f"b{x} long" for x in range(BITMAP))
    fields = table.select("h", "left", "right", "n", "seq", "bits")
    e = fields.where("left").mapInPandas(emit(True), shape).select("s", F.col("h").alias("h_eval"), "n", "p", "i", *[F.col(f"b{x}").alias(f"e{x}") for x in range(BITMAP)])

    def substrings_of(rows: DataFrame) -> DataFrame:
        return rows.where("right").mapInPandas(emit(False), shape).select("s", F.col("h").alias("h_train"), F.col("n").alias("m"), F.col("p").alias("q"), *[F.col(f"b{x}").alias(f"t{x}") for x in range(BITMAP)])

    hot = hot_values(substrings_of(fields.where(F.pmod("h", F.lit(64)) == 0)), join_hash(["s"]))
    k = F.floor(F.col("n") * ((1 - t) / t) + 1e-9)
    limit = F.floor((F.col("n") + F.col("m")) * ((1 - t) / (1 + t)) + 1e-9)
    move, rest = F.col("q") - F.col("p"), F.col("m") - F.col("n") - (F.col("q") - F.col("p"))
    apart = sum((F.bit_count(F.col(f"e{x}").bitwiseXOR(F.col(f"t{x}"))) for x in range(BITMAP)), F.lit(0))
    close = (F.abs(move) <= F.col("i")) & (F.abs(rest) <= k - F.col("i")) & (F.abs(move) + F.abs(rest) <= limit) & (apart <= limit)
    found = cut(skew_join(substrings_of(fields), e, ["s"], F.col("h_train"), hot=hot).where(close).select("h_eval", "h_train").distinct(), "overlap-candidates")
    left_seq = table.where("left").select(F.col("h").alias("h_eval"), F.col("c").alias("c_eval"), F.col("seq").alias("x"))
    right_seq = table.where("right").select(F.col("h").alias("h_train"), F.col("c").alias("c_train"), F.col("seq").alias("y"))

    def verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            size = part["x"].map(len) + part["y"].map(len)
            part = part.iloc[np.argsort(size.to_numpy(), kind="stable")]
            size = np.sort(size.to_numpy())
            lo = 0
            while lo < len(part):  # pairs of about one length together, at most some MB of diagonals
                hi = min(len(part), lo + max(1, 2_000_000 // int(size[lo] + 8)))
                hi = max(lo + 1, min(hi, int(np.searchsorted(size, size[lo] * 1.3 + 8, side="right"))))
                some = part.iloc[lo:hi]
                d = banded_distance([np.asarray(v) for v in some["x"]], [np.asarray(v) for v in some["y"]], t)
                total = size[lo:hi]
                common = (total - d) // 2
                ok = (d <= total) & (common >= t * (total - common) - 1e-9)
                yield pd.DataFrame({"c_eval": some["c_eval"][ok], "c_train": some["c_train"][ok], "common": common[ok], "distinct_words": (total - common)[ok]})
                lo = hi

    hot_eval, hot_train = hot_values(found, join_hash(["h_eval"])), hot_values(found, join_hash(["h_train"]))
    with_x = skew_join(found, left_seq, ["h_eval"], F.col("h_train"), hot=hot_eval)
    both = skew_join(with_x, right_seq, ["h_train"], F.col("c_eval"), hot=hot_train).select("c_eval", "c_train", "x", "y")
    pairs = small_batches(both).mapInPandas(verify, "c_eval string, c_train string, common long, distinct_words long")
    return pairs, members.withColumnRenamed("id", key if key not in ("c", "side", *(carry or {})) else f"{key}_")


def _emitted(part: pd.DataFrame, left: bool, t: float) -> pd.DataFrame:
    """The segments (``left``) or substrings of some strings, each with its class, length, place and bitmap."""
    keys, row, pos, seg = [], [], [], []
    for r, (n, seq) in enumerate(zip(part["n"], part["seq"], strict=True)):
        seq = np.asarray(seq, dtype=np.int64)
        p, ln = layout(int(n), t).T if left else substrings(int(n), t)
        keys.append(segment_keys(seq, p, ln))
        pos.append(p)
        seg.append(np.arange(len(p)))
        row.append(np.full(len(p), r))
    at = np.concatenate(row)
    bits = np.stack(part["bits"].to_numpy())
    out = {"s": np.concatenate(keys), "h": part["h"].to_numpy()[at], "n": part["n"].to_numpy()[at], "p": np.concatenate(pos), "i": np.concatenate(seg)}
    return pd.DataFrame(out | {f"b{x}": bits[at, x] for x in range(BITMAP)})


def member_pairs(pairs: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """(eval_id, train_id) for every pair of classes and every two of their members. A hot class's members are spread over
    several tasks on either side."""
    rows = members.where(F.col("side") == "eval").select(F.col("c").alias("c_eval"), F.col(key).alias("eval_id"))
    others = members.where(F.col("side") == "train").select(F.col("c").alias("c_train"), F.col(key).alias("train_id"))
    half = skew_join(rows, pairs.select("c_eval", "c_train"), ["c_eval"], F.col("eval_id"))
    return skew_join(others, half, ["c_train"], F.col("train_id")).select("eval_id", "train_id")


def overlap_counts(pairs: DataFrame, members: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by`` (carried columns), ``overlapping`` (evaluation members that have a partner) and ``pairs`` (of members), from
    the pairs of classes and the sizes of classes: no pair of members is listed. A member with several texts on its side
    counts with each."""
    pairs = cut(pairs.select("c_eval", "c_train"), "overlap-pairs")
    sizes = members.where(F.col("side") == "train").groupBy(F.col("c").alias("c_train")).agg(F.count("*").alias("n"))
    partners = skew_join(pairs, sizes, ["c_train"], F.col("c_eval")).groupBy(F.col("c_eval").alias("c")).agg(F.sum("n").alias("n"))
    groups = members.where(F.col("side") == "eval").groupBy("c", *by).agg(F.count("*").alias("k"))
    return groups.join(partners.hint("merge"), "c").groupBy(*by).agg(F.sum("k").alias("overlapping"), F.sum(F.col("k") * F.col("n")).alias("pairs"))
