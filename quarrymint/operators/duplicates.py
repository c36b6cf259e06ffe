"""Near-duplicate texts across sides: pairs of blocks of about one length, thinned out by word sets and longest common
subsequences, then the ratio of matching blocks."""

from __future__ import annotations

import difflib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymint.functions.text import tokens
from quarrymint.session import cut, skew_join

#: White space of any script.
_SPACE = r"(?U)[\s\x1c-\x1f]+"
_WORD = re.compile(r"\*\*|\^|[a-z0-9_]+")
#: Hash buckets of words whose counts give the common order of words, and the words that have a bit of their own.
WORD_BUCKETS, OWN_BITS = 1 << 16, 400
#: Texts of a block: so many parts of all texts, within bounds, and no more characters than this. Texts and characters packed at once.
BLOCKS, LEAST_BLOCK, MOST_BLOCK, BLOCK_CHARS, PACK_TEXTS, PACK_CHARS = 8, 1 << 12, 1 << 16, 3 << 22, 1 << 14, 1 << 23
#: Lengths up to here are told apart; longer ones by steps of one part in 64. Sides with a smaller share than this are put together.
EXACT_CHARS, SMALL_SIDE = 4096, 1 / 64
#: How many pairs of a tile cost as much as one pair that is looked up.
GATHER = 8
#: Characters of texts whose common subsequences are found for many pairs at once.
SHORT = 1024


def _span(bucket: int) -> tuple[int, int]:
    """The lengths of a bucket of :func:`_length_bucket`, with room for rounding."""
    if bucket <= EXACT_CHARS:
        return bucket, bucket
    low = EXACT_CHARS * (65 / 64) ** (bucket - EXACT_CHARS - 1)
    return max(EXACT_CHARS, int(low) - 1), int(low * 65 / 64) + 2


def _length_bucket(chars: Column) -> Column:
    steps = F.floor(F.log(chars / F.lit(float(EXACT_CHARS))) / F.log(F.lit(65 / 64))) + F.lit(EXACT_CHARS + 1)
    return F.when(chars <= EXACT_CHARS, chars).otherwise(steps).cast("int")


def _blocks(sizes: list, small: set[str]) -> tuple[list[tuple], list[tuple[int, int, int, int, bool]]]:
    """Blocks from (side, length bucket, texts): rows (side, bucket, first block, blocks of that bucket), and for each
    block its number, least and greatest length, group of sides and whether that holds several sides."""
    n = sum(s["n"] for s in sizes)
    most = min(MOST_BLOCK, max(LEAST_BLOCK, n // BLOCKS))
    groups: dict[str | None, dict[int, int]] = {}
    for s in sizes:
        of = groups.setdefault(None if s["side"] in small else s["side"], {})
        of[s["bucket"]] = of.get(s["bucket"], 0) + s["n"]
    at: dict[tuple, tuple[int, int]] = {}
    blocks: list[tuple] = []
    for g, (side, of) in enumerate(groups.items()):
        filled = 1.0
        for bucket in sorted(of):
            low, high = _span(bucket)
            part = of[bucket] / max(1, min(most, BLOCK_CHARS // max(1, high)))
            if part > 1:  # one length fills several blocks
                parts = math.ceil(part)
                at[side, bucket] = len(blocks), parts
                blocks += [(len(blocks) + p, low, high, g, side is None) for p in range(parts)]
                filled = 1.0
                continue
            if filled + part > 1:
                blocks.append((len(blocks), low, high, g, side is None))
                filled = 0.0
            filled += part
            b = blocks[-1]
            blocks[-1] = (b[0], b[1], high, *b[3:])
            at[side, bucket] = b[0], 1
    rows = [(s["side"], s["bucket"], *at[None if s["side"] in small else s["side"], s["bucket"]]) for s in sizes]
    return rows, blocks


_PARTS = (("id", np.int64), ("side", np.int32), ("n", np.int32), ("words", np.uint32), ("bytes", np.int32))


def _packed(order: np.ndarray, sides: dict[str, int]):
    """Batches of texts as one compressed row for each block in them: its number, the bytes of the text and what _PARTS says."""

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, texts, chars = [], 0, 0
        for part in parts:
            kept.append(part)
            texts, chars = texts + len(part), chars + int(part["chars"].sum())
            if texts >= PACK_TEXTS or chars >= PACK_CHARS:
                yield some(pd.concat(kept, ignore_index=True))
                kept, texts, chars = [], 0, 0
        if kept:
            yield some(pd.concat(kept, ignore_index=True))

    def some(part: pd.DataFrame) -> pd.DataFrame:
        codec, out = pa.Codec("zstd", compression_level=6), []
        for block, rows in part.groupby("block"):
            n = rows["words"].map(len).to_numpy(np.int32)
            h = np.concatenate(rows["words"].to_list()).astype(np.int64).view(np.uint64)
            rank = order[(h & np.uint64(WORD_BUCKETS - 1)).astype(np.int64)].astype(np.uint64)
            ids = rank << np.uint64(16) | (h >> np.uint64(16)) & np.uint64(0xFFFF)
            at = np.repeat(np.arange(len(rows), dtype=np.uint64), n)
            ids = (np.sort(at << np.uint64(32) | ids) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            raw = [x.encode() for x in rows["norm"]]
            values = {"id": rows["id"].to_numpy(), "side": rows["side"].map(sides).to_numpy(), "n": n, "words": ids, "bytes": np.array([len(x) for x in raw])}
            blob = b"".join([*[np.ascontiguousarray(values[k], dtype=t).tobytes() for k, t in _PARTS], *raw])
            out.append((block, len(rows), len(ids), len(blob), codec.compress(blob, asbytes=True)))
        return pd.DataFrame(out, columns=["block", "texts", "total", "size", "blob"])

    return pack


class _Block:
    """The texts of one block."""

    def __init__(self, rows: pd.DataFrame):
        got: dict[str, list] = {k: [] for k, _ in _PARTS}
        self.text: list[str] = []
        for texts, total, size, blob in zip(rows["texts"], rows["total"], rows["size"], rows["blob"], strict=True):
            raw, at = pa.Codec("zstd").decompress(blob, decompressed_size=int(size), asbytes=True), 0
            for k, t in _PARTS:
                count = int(total if k == "words" else texts)
                got[k].append(np.frombuffer(raw, dtype=t, count=count, offset=at))
                at += count * np.dtype(t).itemsize
            for b in got["bytes"][-1].tolist():
                self.text.append(raw[at : at + b].decode())
                at += b
        self.id, self.side, self.n, self.words = (np.concatenate(got[k]) for k in ("id", "side", "n", "words"))
        self.n = self.n.astype(np.int64)
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        self.place = np.arange(len(self.words)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        self.chars = np.array([len(x) for x in self.text], dtype=np.int64)
        self.bits = self._bits((self.words * np.uint32(2654435761)) >> np.uint32(8), 256, 255)  # 255, so that numbers of bits fit a byte
        frequent = WORD_BUCKETS - 1 - (self.words >> np.uint32(16)).astype(np.int64)
        mixed = (self.words * np.uint32(2246822519)) >> np.uint32(8)
        self.more = self._bits(np.where(frequent < OWN_BITS, frequent, OWN_BITS + mixed % (512 - OWN_BITS)), 512, 512)
        self.code, self.start = np.empty(int(self.chars.sum()), dtype=np.uint8), np.cumsum(self.chars) - self.chars
        self.letters = np.zeros((len(self.n), 64), dtype=np.int32)
        for lo in range(0, len(self.n), 2048):
            some = self.chars[lo : lo + 2048]
            code = (np.frombuffer("".join(self.text[lo : lo + 2048]).encode("utf-32-le"), dtype=np.uint32) & np.uint32(63)).astype(np.uint8)
            self.code[self.start[lo] : self.start[lo] + len(code)] = code
            of = np.repeat(np.arange(len(some)), some) * 64 + code
            self.letters[lo : lo + 2048] = np.bincount(of, minlength=64 * len(some)).reshape(-1, 64)

    def _bits(self, at: np.ndarray, size: int, used: int) -> np.ndarray:
        on = np.zeros((len(self.n), size), dtype=np.uint8)
        on[self.row, at.astype(np.int64) % used] = 1
        return np.packbits(on, axis=1).view(np.uint64)


def _outer(x: _Block, y: _Block, overlap: float, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of texts that may overlap enough. A word at place i of n, in the common order, can be the first that is shared
    with a text of at most (n - i)(1 + t) / t - n words; both must allow for the size of the other."""
    t, least, more = overlap, ratio / (2 - ratio), (1 - overlap) / (1 + overlap)
    entries = []
    for a, b in ((x, y), (y, x)):
        n = a.n[a.row]
        reach = np.floor((n - a.place) * ((1 + t) / t) - n + 1e-6)
        e = np.flatnonzero(reach >= np.maximum(b.n.min(), t * n - 1e-6))
        entries.append((a.words[e], a.row[e], reach[e]))
    common = np.intersect1d(entries[0][0], entries[1][0])
    if not len(common):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sides = []
    for (w, row, reach), a in zip(entries, (x, y), strict=True):
        g = np.searchsorted(common, w)
        on = common[np.minimum(g, len(common) - 1)] == w
        g, row, reach = g[on], row[on], reach[on]
        s = np.lexsort((a.n[row], g))
        sides.append((np.searchsorted(g[s], np.arange(len(common) + 1)), row[s], reach[s]))
    (xs, xrow, xreach), (ys, yrow, yreach) = sides
    p, q = np.diff(xs), np.diff(ys)
    found = []

    def kept(a: np.ndarray, b: np.ndarray) -> None:
        """Of pairs of rows, those that the finer bounds allow."""
        for lo in range(0, len(a), 1 << 15):
            i, j = a[lo : lo + (1 << 15)], b[lo : lo + (1 << 15)]
            c, d = x.chars[i], y.chars[j]
            ok = (x.side[i] != y.side[j]) & (np.minimum(c, d) >= least * np.maximum(c, d) - 1e-6)
            i, j = i[ok], j[ok]
            limit = (x.n[i] + y.n[j]) * more + 1e-6
            ok = np.bitwise_count(x.more[i] ^ y.more[j]).sum(axis=1, dtype=np.int64) <= limit
            i, j = i[ok], j[ok]
            other = np.abs(x.letters[i] - y.letters[j]).sum(axis=1)
            ok = other <= (1 - ratio) * (x.chars[i] + y.chars[j]) + 1e-6
            found.append(i[ok] * len(y.n) + j[ok])

    total = np.cumsum(p * q)
    if total[-1] * GATHER > len(x.n) * len(y.n):  # frequent words: all pairs by tiles cost less
        _tiles(x, y, t, kept)
    else:
        for lo in range(0, total[-1], 1 << 17):
            at = np.arange(lo, min(total[-1], lo + (1 << 17)))
            g = np.searchsorted(total, at, side="right")
            k = at - total[g] + (p * q)[g]
            i, j = xs[g] + k // q[g], ys[g] + k % q[g]
            a, b = xrow[i], yrow[j]
            ok = (x.n[a] <= yreach[j]) & (y.n[b] <= xreach[i])
            a, b = a[ok], b[ok]
            ok = np.bitwise_count(x.bits[a] ^ y.bits[b]).sum(axis=1, dtype=np.int64) <= (x.n[a] + y.n[b]) * more + 1e-6
            kept(a[ok], b[ok])
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs // len(y.n), pairs % len(y.n)


def _tiles(x: _Block, y: _Block, t: float, kept: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Gives ``kept`` all pairs that sizes and bitmaps allow."""
    more = (1 - t) / (1 + t)
    xo, yo = np.argsort(x.n, kind="stable"), np.argsort(y.n, kind="stable")
    u, v, xn, yn = x.bits[xo], y.bits[yo].T.copy(), x.n[xo], y.n[yo]
    xfar, yfar = (np.minimum(np.ceil(n * more), 127).astype(np.uint8) for n in (xn, yn))
    wide, narrow, apart = (np.empty((32, 1024), dtype=k) for k in (np.uint64, np.uint8, np.uint8))
    hits, waiting = [], 0
    for lo in range(0, len(xo), 32):
        hi = min(len(xo), lo + 32)
        first, last = np.searchsorted(yn, [xn[lo] * t - 1e-6, xn[hi - 1] / t + 1e-6], side="left")
        for k in range(first, last, 1024):
            end = min(last, k + 1024)
            xor, some, d = wide[: hi - lo, : end - k], narrow[: hi - lo, : end - k], apart[: hi - lo, : end - k]
            for w in range(4):
                np.bitwise_xor(u[lo:hi, w, None], v[w, None, k:end], out=xor)
                np.bitwise_count(xor, out=some if w else d)
                if w:
                    d += some
            np.add(xfar[lo:hi, None], yfar[None, k:end], out=some)
            near = d <= some
            if xfar[hi - 1] == 127 or yfar[end - 1] == 127:  # sizes beyond a byte rule nothing out
                near |= (xfar[lo:hi, None] == 127) | (yfar[None, k:end] == 127)
            r, z = np.nonzero(near)
            if len(r):
                hits.append((xo[lo + r], yo[k + z]))
                waiting += len(r)
            if waiting >= 1 << 15:
                kept(*[np.concatenate(h) for h in zip(*hits, strict=True)])
                hits, waiting = [], 0
    if hits:
        kept(*[np.concatenate(h) for h in zip(*hits, strict=True)])


def _may_align(x: _Block, y: _Block, i: np.ndarray, j: np.ndarray, ratio: float) -> np.ndarray:
    """False for pairs whose longest common subsequence cannot make the ratio. A letter of ``x`` at place p can only be
    matched at p - d to p + e of ``y``, where d and e letters of either may be left over; so each 64 letters of ``x``, one
    word of bits, leave over what has no common subsequence with those of ``y`` that they reach."""
    out = np.zeros(len(i), dtype=bool)
    for lo in range(0, len(i), 4096):
        on = np.arange(lo, min(len(i), lo + 4096))
        n, m = x.chars[i[on]], y.chars[j[on]]
        spare, other = _spare(n, m, ratio), _spare(m, n, ratio)
        ok = (spare >= 0) & (other >= 0)
        first = 0
        while True:
            done = ok & (first >= n)
            out[on[done]] = True
            ok &= first < n
            on, n, m, spare, other = (v[ok] for v in (on, n, m, spare, other))
            if not len(on):
                break
            a, b, rows = x.start[i[on]], y.start[j[on]], np.arange(len(on))
            size = np.minimum(64, n - first)
            where = np.zeros((len(on), 65), dtype=np.uint64)
            for k in range(int(size.max())):
                to = np.where(k < size, x.code[np.minimum(a + first + k, len(x.code) - 1)], 64)
                where[rows, to] |= np.uint64(1 << k)
            where[:, 64] = 0
            low, high = np.maximum(0, first - _spare(n, m, ratio)), np.minimum(m, first + size + other)
            flat, base = where.ravel(), rows * 65
            v = np.full(len(on), ~np.uint64(0))
            for k in range(int((high - low).max())):
                at = low + k
                u = v & flat[base + np.where(at < high, y.code[np.minimum(b + at, len(y.code) - 1)], 64)]
                v = (v + u) | (v ^ u)
            spare = spare - (size - np.bitwise_count(~v).astype(np.int64))
            ok = spare >= 0
            first += 64
    return out


def _spare(n: np.ndarray, m: np.ndarray, ratio: float) -> np.ndarray:
    """Letters of texts of ``n`` letters that may be left over against texts of ``m``."""
    return n - np.ceil((n + m) * (ratio / 2) - 1e-6).astype(np.int64)


def common_subsequences(x: _Block, y: _Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """At least the length of the longest common subsequence of each pair, by bit-parallel rows; letters go by their last six bits."""
    out = np.empty(len(i), dtype=np.int64)
    for lo in range(0, len(i), 1024):
        a, b = i[lo : lo + 1024], j[lo : lo + 1024]
        rows, n, m = len(a), x.chars[a], y.chars[b]
        width, steps = -(-int(m.max()) // 64), int(n.max())
        at = np.arange(rows)
        where = np.zeros((rows, 65, width), dtype=np.uint64)
        for k in range(int(m.max())):
            on = at[k < m]
            where[on, y.code[y.start[b[on]] + k], k >> 6] |= np.uint64(1 << (k & 63))
        where = where.reshape(rows * 65, width)
        step = np.minimum(np.arange(steps)[:, None], n[None, :] - 1) + x.start[a][None, :]
        letter = np.where(np.arange(steps)[:, None] < n[None, :], x.code[step], 64) + at[None, :] * 65
        v = np.full((rows, width), ~np.uint64(0))
        for k in range(steps):
            u = v & where[letter[k]]
            s = v + u
            carry = s < v
            while width > 1 and carry[:, :-1].any():
                s[:, 1:] += carry[:, :-1]
                over = np.zeros_like(carry)
                over[:, 1:] = carry[:, :-1] & (s[:, 1:] == 0)
                carry = over
            v = s | (v ^ u)
        out[lo : lo + 1024] = np.bitwise_count(~v).sum(axis=1, dtype=np.int64)
    return out


def _subsequence(a: str, b: str) -> int:
    where: dict[str, int] = {}
    for k, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(b)) - 1
    v = full
    for c in a:
        u = v & where.get(c, 0)
        v = (v + u | v - u) & full
    return len(b) - v.bit_count()


def _judge(x: _Block, y: _Block, overlap: float, ratio: float, names: list[str]) -> list[tuple]:
    i, j = _outer(x, y, overlap, ratio)
    ok, swap = np.zeros(len(i), dtype=bool), x.chars[i] > y.chars[j]
    ok[~swap] = _may_align(x, y, i[~swap], j[~swap], ratio)  # the shorter one has fewer letters to spare
    ok[swap] = _may_align(y, x, j[swap], i[swap], ratio)
    i, j = i[ok], j[ok]
    size = np.maximum(x.chars[i], y.chars[j])
    s = np.argsort(size, kind="stable")
    i, j, size = i[s], j[s], size[s]
    short = int(np.searchsorted(size, SHORT, side="right"))
    common = [*common_subsequences(x, y, i[:short], j[:short]), *[_subsequence(x.text[a], y.text[b]) for a, b in zip(i[short:], j[short:], strict=True)]]
    ok = 2.0 * np.array(common, dtype=np.float64) >= ratio * (x.chars[i] + y.chars[j]) - 1e-6
    out = []
    for a, b in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
        first, second = sorted([(x.text[a], names[x.side[a]], int(x.id[a])), (y.text[b], names[y.side[b]], int(y.id[b]))])
        u, v = (set(_WORD.findall(z[0])) for z in (first, second))
        shared = len(u & v) / len(u | v)
        if shared >= overlap and (r := difflib.SequenceMatcher(None, first[0], second[0]).ratio()) >= ratio:
            out.append((first[2], second[2], r, shared))
    return out


def near_duplicates(df: DataFrame, key: str, text: str, side: Column, overlap: float = 0.45, ratio: float = 0.88) -> DataFrame:
    """Pairs of classes of equal normalized texts on different sides whose word sets agree in at least ``overlap`` of all
    their words and whose matching blocks make at least ``ratio``: left, right (least keys of the classes; left is the one
    whose text comes first, of equal texts the one whose side does), their sides and numbers of rows, similarity and token_overlap.

    Null keys, sides and texts, and texts without words, are in no pair. Exact: classes of one side and about one length
    make blocks, and a task takes two blocks whose sides differ and whose lengths the ratio allows. There, words are
    ordered from the rarest, and texts meet at a word that can be the first they share, given the sizes of both. Bitmaps
    of the words, counts of letters and the longest common subsequence, none of which can rule out a pair that counts,
    leave few pairs to be judged. Only compressed blocks and the pairs that count are written or shuffled.
    """
    base = df.select(F.col(f"`{key}`").alias("key"), side.cast("string").alias("side"), F.trim(F.regexp_replace(F.lower(F.col(f"`{text}`")), _SPACE, " ")).alias("norm")).where("key is not null and side is not null and norm is not null")
    base = cut(base, "near-texts")
    hashes = [F.xxhash64("side", "norm").alias("h1"), F.xxhash64("side", "norm", F.lit(9)).alias("h2")]
    classes = base.groupBy("side", "norm").agg(F.min("key").alias("key")).where(F.size(tokens(F.col("norm"))) > 0)
    classes = cut(classes.select(F.monotonically_increasing_id().alias("id"), "side", "norm", "key", *hashes), "near-classes")
    spark = df.sparkSession
    words = F.transform(F.array_distinct(tokens(F.col("norm"))), lambda w: F.xxhash64(w))
    texts = classes.select("id", "side", "norm", F.length("norm").alias("chars"), _length_bucket(F.length("norm")).alias("bucket"))
    sizes = texts.groupBy("side", "bucket").agg(F.count("*").alias("n")).orderBy("side", "bucket").collect()
    names = sorted({s["side"] for s in sizes})
    of_side = dict.fromkeys(names, 0)
    for s in sizes:
        of_side[s["side"]] += s["n"]
    small = {k for k, n in of_side.items() if n < SMALL_SIDE * sum(of_side.values())}
    places, blocks = _blocks(sizes, small)
    least = ratio / (2 - ratio)
    fit = lambda a, b: least * max(a[1], b[1]) <= min(a[2], b[2]) + 1e-6
    both = [(a[0], b[0]) for a in blocks for b in blocks if a[0] <= b[0] and (a[3] != b[3] or a[4]) and fit(a, b)]
    shape = "a long, b long, s double, o double"
    if both:
        counts = np.zeros(WORD_BUCKETS, dtype=np.int64)
        for r in classes.select(F.explode(words).alias("h")).groupBy(F.col("h").bitwiseAND(WORD_BUCKETS - 1).cast("int").alias("b")).agg(F.count("*").alias("n")).collect():
            counts[r["b"]] = r["n"]
        order = np.empty(WORD_BUCKETS, dtype=np.uint32)
        order[np.argsort(counts, kind="stable")] = np.arange(WORD_BUCKETS, dtype=np.uint32)
        tasks = len(both)
        slot = F.pmod(F.hash("id"), F.lit(tasks)).cast("int")  # a number that goes to each task
        numbers = {r["p"]: r["id"] for r in spark.range(64 * tasks + 1024).groupBy(slot.alias("p")).agg(F.min("id").alias("id")).collect()}
        pair_rows = [(numbers.get(k, -k - 1), a, b) for k, (a, b) in enumerate(both)]
        to = spark.createDataFrame([(k, v) for k, a, b in pair_rows for v in {a, b}], "pair long, block int")
        of_pair = {k: (a, b) for k, a, b in pair_rows}
        at = spark.createDataFrame(places, "side string, bucket int, first int, parts int")
        placed = texts.withColumn("words", words).join(F.broadcast(at), ["side", "bucket"]).withColumn("block", (F.col("first") + F.pmod(F.hash("id"), "parts")).cast("int"))
        packed = placed.select("id", "side", "norm", "chars", "block", "words").mapInPandas(_packed(order, {v: k for k, v in enumerate(names)}), "block int, texts int, total int, size long, blob binary")
        sent = packed.join(F.broadcast(to), "block").repartition(tasks, "pair")

        def judge(rows: pd.DataFrame) -> pd.DataFrame:
            a, b = of_pair[int(rows["pair"].iloc[0])]
            x = _Block(rows[rows["block"] == a])
            got = _judge(x, x if a == b else _Block(rows[rows["block"] == b]), overlap, ratio, names)
            return pd.DataFrame(list(dict.fromkeys(got)), columns=["a", "b", "s", "o"])

        found = cut(sent.groupBy("pair").applyInPandas(judge, shape), "near-pairs")
    else:
        found = spark.createDataFrame([], shape)
    picked = classes.select("id", "key", "side", "h1", "h2")
    one = skew_join(found, picked.select(F.col("id").alias("a"), *[F.col(c).alias(f"l_{c}") for c in picked.columns[1:]]), ["a"], F.col("b"))
    two = skew_join(one, picked.select(F.col("id").alias("b"), *[F.col(c).alias(f"r_{c}") for c in picked.columns[1:]]), ["b"], F.col("a"))
    rows = base.select(*hashes, "key").groupBy("h1", "h2").agg(F.count_distinct("key").alias("rows"))
    for c in ("l", "r"):
        two = two.join(rows.select(*[F.col(v).alias(f"{c}_{v}") for v in rows.columns]).hint("merge"), [f"{c}_h1", f"{c}_h2"])
    return two.select(F.col("l_key").alias("left"), F.col("r_key").alias("right"), F.col("l_side").alias("left_side"), F.col("r_side").alias("right_side"), F.col("l_rows").alias("left_rows"), F.col("r_rows").alias("right_rows"), F.bround("s", 4).alias("similarity"), F.bround("o", 4).alias("token_overlap"))
