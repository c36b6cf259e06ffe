"""The k most similar vectors for every vector, by a hierarchical k-means tree (problem 1)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymint.session import cut, drop, skew_join

#: Vectors a leaf should hold; children of an inner node (a power of two); sample per leaf to fit the tree, and at most.
LEAF_SIZE, BRANCH, SAMPLE_PER_LEAF, MOST_SAMPLE = 512, 16, 16, 1 << 18
#: Vectors, none of them in the sample, whose true neighbours calibrate the number of leaves to visit; the number of such
#: neighbours from ``least`` on that is enough to go by.
CALIBRATION, ENOUGH = 512, 200
#: Most vectors and queries that one task compares at once; more below one inner node are dealt to blocks.
POINT_BLOCK, QUERY_BLOCK = 16384, 16384
#: Vectors that a task holds while it routes or compares.
ROWS = 8192
#: What single precision may move a cosine by; candidates this near the last place are compared in double precision.
SLACK = 4e-6


@dataclass
class Tree:
    """Unit centres of all nodes, the root first, children of a node side by side. A leaf's code is its parent times BRANCH
    plus its place, so the code tells the parent."""

    centres: np.ndarray
    first: np.ndarray
    count: np.ndarray  # 0: a leaf
    code: np.ndarray
    compared: int = field(default=0, compare=False)

    @property
    def leaves(self) -> np.ndarray:
        return self.code[self.count == 0]

    def visits(self, q: np.ndarray, most: int) -> np.ndarray:
        """For each query the codes of the first ``most`` leaves, best bin first: a priority queue of open nodes by the
        similarity of their centres; the best is taken off, an inner node's children are compared and put on, a leaf is
        visited. All queries take a step together; centres below a node that is not opened are never compared."""
        n, most = len(q), min(most, int((self.count == 0).sum()))
        out, got = np.full((n, most), -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
        node = np.zeros((n, BRANCH), dtype=np.int64)
        sim = np.full((n, BRANCH), -np.inf, dtype=np.float32)
        sim[:, 0] = np.inf
        used = np.ones(n, dtype=np.int64)
        live = np.arange(n)
        while len(live):
            at = np.argmax(sim[live], axis=1)
            best = node[live, at]
            sim[live, at] = -np.inf
            leaf = self.count[best] == 0
            done = live[leaf]
            out[done, got[done]] = self.code[best[leaf]]
            got[done] += 1
            rows, inner = live[~leaf], best[~leaf]
            if len(rows):
                if used[rows].max() + BRANCH > sim.shape[1]:
                    more = sim.shape[1]
                    node = np.concatenate([node, np.zeros((n, more), dtype=np.int64)], axis=1)
                    sim = np.concatenate([sim, np.full((n, more), -np.inf, dtype=np.float32)], axis=1)
                order = np.argsort(inner, kind="stable")
                rows, inner = rows[order], inner[order]
                ends = np.append(np.flatnonzero(np.diff(inner)) + 1, len(inner))
                start = 0
                for end in ends:
                    i, some = inner[start], rows[start:end]
                    kids = np.arange(self.first[i], self.first[i] + self.count[i])
                    place = used[some][:, None] + np.arange(len(kids))
                    sim[some[:, None], place] = q[some] @ self.centres[kids].T
                    node[some[:, None], place] = kids
                    used[some] += len(kids)
                    self.compared += len(some) * len(kids)
                    start = end
            live = live[got[live] < most]
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: unit centres and the centre of each row. Empty centres are dropped."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    near = np.argmax(x @ centres.T, axis=1)
    for _ in range(rounds):
        order = np.argsort(near, kind="stable")
        first = np.flatnonzero(np.diff(near[order], prepend=-1))
        sums = np.add.reduceat(x[order], first, axis=0)
        size = np.linalg.norm(sums, axis=1)
        keep = size > 1e-6
        if not keep.any():
            break
        centres = sums[keep] / size[keep][:, None]
        near = np.argmax(x @ centres.T, axis=1)
    return centres, near


def fit_tree(sample: np.ndarray, leaves: int, seed: int = 7) -> Tree:
    """A tree of about ``leaves`` leaves over unit vectors, as deep as these need at BRANCH children a node; the nodes
    below one get leaves in proportion to their sample."""
    rng = np.random.default_rng(seed)
    centres, first, count, code = [np.zeros(sample.shape[1], dtype=np.float32)], [0], [0], [0]
    todo = [(0, sample, leaves)]
    for node, own, share in todo:  # grows while it is read
        if share < 2 or len(own) < 2:
            continue
        below = max(2, min(BRANCH, share))
        mid, near = _kmeans(own, below, rng)
        if len(mid) < 2:
            continue
        first[node], count[node] = len(centres), len(mid)
        for i in range(len(mid)):
            part = own[near == i]
            todo.append((len(centres), part, round(share * len(part) / len(own))))
            centres.append(mid[i])
            first.append(0)
            count.append(0)
            code.append(node * BRANCH + i)
    return Tree(np.stack(centres).astype(np.float32), np.array(first), np.array(count), np.array(code, dtype=np.int64))


# --- Arrow helpers


def _vectors(col, d: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten(), dtype=np.float32).reshape(len(col), d) if len(col) else np.zeros((0, d), dtype=np.float32)


def _lists(values: np.ndarray, sizes: np.ndarray, kind) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Tables of about ROWS rows of vectors of one length."""
    held: list[pa.RecordBatch] = []

    def flush():
        whole = pa.Table.from_batches(held)
        dims = whole["dim"].to_numpy()
        for d in np.unique(dims):
            yield int(d), whole.filter(pa.array(dims == d))

    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(h.num_rows for h in held) >= ROWS:
            yield from flush()
            held = []
    if held:
        yield from flush()


# --- the operator


def usable_vectors(df: DataFrame, key: str, vector: Column, dim: Column) -> DataFrame:
    """``id``, ``dim``, ``c`` (class of identical vectors) and ``v`` (unit vector) of the usable vectors: as long as ``dim``
    says, finite, without nulls, not all zero."""
    ok = (F.size(vector) == dim) & (dim > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    picked = df.select(F.col(f"`{key}`").cast("string").alias("id"), vector.cast("array<double>").alias("x"), dim.cast("int").alias("dim")).where(F.col("id").isNotNull() & F.coalesce(ok, F.lit(False)))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, part in _by_length(batches):
            x = np.asarray(part["x"].combine_chunks().flatten()).reshape(part.num_rows, d)
            x = x / np.abs(x).max(axis=1)[:, None]
            x = (x / np.sqrt((x * x).sum(axis=1))[:, None]).astype(np.float32)
            v = _lists(x.ravel(), np.full(len(x), d), pa.float32())
            yield pa.RecordBatch.from_arrays([part["id"].combine_chunks(), part["dim"].combine_chunks(), v], ["id", "dim", "v"])

    done = picked.mapInArrow(unit, "id string, dim int, v array<float>")
    return done.select("id", "dim", F.concat(F.hex(F.xxhash64("v")), F.lit("-"), F.hex(F.xxhash64("v", F.lit(3)))).alias("c"), "v")


def _first(r: np.ndarray, c: np.ndarray, v: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Of (row, point, similarity) triples the places of the first ``k`` of each row by similarity descending, name."""
    order = np.lexsort((names[c], -v, r))
    rows = r[order]
    start = np.searchsorted(rows, rows)
    return order[np.arange(len(rows)) - start < k]


def _best(q: np.ndarray, p: np.ndarray, names: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, similarity rounded to 6 decimals) of the k best points of each query, ties by ``names`` (numbers in
    the order of the points' ids). Single precision finds candidates, double precision decides among them."""
    out = []
    for lo in range(0, len(q), 1024):
        s = q[lo : lo + 1024] @ p.T
        floor = np.full(len(s), least - SLACK)
        if len(p) > k:
            floor = np.maximum(floor, np.partition(s, len(p) - k, axis=1)[:, len(p) - k] - SLACK)
        r, c = np.nonzero(s >= floor[:, None])
        v = np.concatenate([np.round(np.einsum("ij,ij->i", q[lo + r[a : a + 65536]].astype(float), p[c[a : a + 65536]].astype(float)), 6) for a in range(0, len(r), 65536)] or [np.zeros(0)])
        keep = v >= least
        r, c, v = r[keep], c[keep], v[keep]
        some = _first(r, c, v, names, k)
        out.append((lo + r[some], c[some], v[some]))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _order(ids: list[str]) -> np.ndarray:
    """Numbers in the order of the ids."""
    out = np.empty(len(ids), dtype=np.int64)
    out[sorted(range(len(ids)), key=lambda i: ids[i].encode())] = np.arange(len(ids))
    return out


def nearest(df: DataFrame, key: str, vector: Column, dim: Column, k: int = 5, least: float = -1.0, recall: float = 0.998, report: dict | None = None) -> DataFrame:
    """``id``, ``neighbour``, ``similarity``, ``rank``: the ``k`` most similar usable vectors for every usable vector.

    Similarity is the cosine of the unit vectors in single precision, rounded to 6 decimals; equal ones go by the smaller
    id; pairs under ``least`` are left out. Rows with one id are one record. Only vectors of equal length are compared.
    Unusable vectors and empty tables give no rows. A vector that only copies have is found by its copies.

    Method: identical vectors are one class that searches once and offers its k + 1 smallest ids, so a hot vector costs
    one query. For each length a k-means tree is fitted to a bounded sample (SAMPLE_PER_LEAF for each of n / LEAF_SIZE
    leaves, MOST_SAMPLE at most); every class is assigned to its leaf. Leaves to visit are widened from one until the
    visits find ``recall`` of the true neighbours of CALIBRATION other vectors, which a pass over all vectors determines;
    every query then visits that many leaves, best bin first. A query travels once for all the leaves it visits below one
    inner node. Queries and points meet in blocks of bounded size, so no task grows with a hot node. ``report`` gets the
    visits and the recall reached.
    """
    spark = df.sparkSession
    rows = cut(usable_vectors(df, key, vector, dim), "knn-vectors")
    members = cut(rows.select("id", "c").distinct(), "knn-members")
    ids = Window.partitionBy("c").orderBy("id")
    offered = members.withColumn("r", F.row_number().over(ids)).where(F.col("r") <= k + 1).groupBy("c").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # k + 1 at most
    classes = cut(rows.groupBy("c").agg(F.first("dim").alias("dim"), F.first("v").alias("v")).join(offered.hint("merge"), "c"), "knn-classes")
    drop(rows)
    counts = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return spark.createDataFrame([], "id string, neighbour string, similarity double, rank int")
    trees = {d: _fitted(classes.where(F.col("dim") == d), d, n) for d, n in sorted(counts.items())}
    visits = _calibrate(classes, counts, trees, k, least, recall, report)
    found = _search(classes, trees, visits, k + 1, least)
    order = Window.partitionBy("c").orderBy(F.desc("s"), F.col("ids")[0])
    top = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    one = F.transform("ids", lambda i: F.struct((-F.col("s")).alias("s"), i.alias("pid")))
    best = top.groupBy("c").agg(F.slice(F.array_sort(F.flatten(F.collect_list(one))), 1, k + 1).alias("near"))  # (k + 1)^2 at most
    mine = F.slice(F.filter("near", lambda x: x["pid"] != F.col("id")), 1, k)
    each = skew_join(members, best, ["c"], F.col("id")).select("id", F.posexplode(mine).alias("p", "x"))
    return each.select("id", F.col("x.pid").alias("neighbour"), (-F.col("x.s")).alias("similarity"), (F.col("p") + 1).alias("rank"))


def _drawn(classes: DataFrame, seed: int, share: float) -> Column:
    return F.pmod(F.xxhash64("c", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))


def _probe_share(n: int) -> float:
    return min(0.25, 1.2 * CALIBRATION / n)


def _fitted(own: DataFrame, d: int, n: int) -> Tree:
    leaves = max(1, n // LEAF_SIZE)
    if leaves == 1:
        return fit_tree(np.zeros((1, d), dtype=np.float32), 1)
    want = min(leaves * SAMPLE_PER_LEAF, MOST_SAMPLE)
    drawn = own.where(_drawn(own, 11, min(1.0, 1.2 * want / n)) & ~_drawn(own, 13, _probe_share(n))).select("c", "v").toArrow().sort_by("c")
    return fit_tree(_vectors(drawn["v"], d)[:MOST_SAMPLE], min(leaves, max(1, drawn.num_rows // 4)))


def _calibrate(classes: DataFrame, counts: dict, trees: dict[int, Tree], k: int, least: float, recall: float, report: dict | None) -> dict[int, int]:
    """Leaves to visit, for each length; the recall that they reach on the probes goes to ``report``."""
    probes = {}
    for d, tree in trees.items():
        if len(tree.leaves) > 1:
            own = classes.where(F.col("dim") == d)
            drawn = own.where(_drawn(own, 13, _probe_share(counts[d]))).select("c", "v").toArrow().sort_by("c").slice(0, CALIBRATION)
            if drawn.num_rows:
                probes[d] = (drawn["c"].to_pylist(), _vectors(drawn["v"], d))

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        for d, part in _by_length(batches):
            if d not in probes:
                continue
            own, q = probes[d]
            v, c = _vectors(part["v"], d), part["c"].to_pylist()
            number = {x: i for i, x in enumerate(c)}
            r, p, s = _best(q, v, np.arange(len(c)), k + 1, -1.0)
            other = np.array([number.get(own[i], -1) for i in range(len(own))])[r] != p
            r, p, s = r[other], p[other], s[other]
            new = (r, s, v[p])
            if d in best:
                new = tuple(np.concatenate(x) for x in zip(best[d], new, strict=True))
            keep = _first(new[0], np.zeros(len(new[0]), int), new[1], np.zeros(1, int), k)
            best[d] = tuple(x[keep] for x in new)
        for d, (r, s, v) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), d), pa.int32()), pa.array(r, pa.int32()), pa.array(s), _lists(v.ravel(), np.full(len(v), d), pa.float32())], ["dim", "probe", "s", "v"])

    truth = {}
    if probes:
        place = Window.partitionBy("dim", "probe").orderBy(F.desc("s"))
        all_near = classes.select("c", "dim", "v").mapInArrow(brute, "dim int, probe int, s double, v array<float>")
        near = all_near.withColumn("r", F.row_number().over(place)).where(F.col("r") <= k).drop("r").toArrow()  # CALIBRATION x k for each length
        dims = near["dim"].to_numpy()
        truth = {d: near.filter(pa.array(dims == d)) for d in probes}
    visits = {}
    for d, tree in trees.items():
        reached, n_leaves = 1.0, len(tree.leaves)
        v = 1
        if d in truth and truth[d].num_rows:
            s = truth[d]["s"].to_numpy()
            some = s >= least if (s >= least).sum() >= ENOUGH else np.ones(len(s), bool)
            row, home = truth[d]["probe"].to_numpy()[some], tree.visits(_vectors(truth[d]["v"], d), 1)[some, 0]
            while True:
                order = tree.visits(probes[d][1], v)
                reached = float((order[row] == home[:, None]).any(axis=1).mean())
                if reached >= recall or v >= n_leaves:
                    break
                v = min(n_leaves, v + max(1, v // 4))
        visits[d] = v
        if report is not None:
            report[d] = {"vectors": counts[d], "leaves": n_leaves, "visits": v, "recall": reached}
    return visits


def _search(classes: DataFrame, trees: dict[int, Tree], visits: dict[int, int], k: int, least: float) -> DataFrame:
    """c, ids (of a class nearby), s: candidates of every class from the leaves that it visits."""
    spark = classes.sparkSession

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, part in _by_length(batches):
            seen = trees[d].visits(_vectors(part["v"], d), visits[d])
            cols = [part[x].combine_chunks() for x in ("c", "dim", "v", "ids")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seen[:, 0]), _lists(seen.ravel(), np.full(len(seen), seen.shape[1]), pa.int64())], ["c", "dim", "v", "ids", "leaf", "leaves"])

    routed = cut(classes.select("c", "dim", "v", "ids").mapInArrow(route, "c string, dim int, v array<float>, ids array<string>, leaf long, leaves array<long>"), "knn-routed")
    drop(classes)
    bits = BRANCH.bit_length() - 1
    group = lambda c: F.shiftright(c, bits)
    asks = routed.select("dim", F.explode(F.array_distinct(F.transform("leaves", group))).alias("g")).groupBy("dim", "g").agg(F.count("*").alias("q"), F.lit(0).alias("p"))
    has = routed.groupBy("dim", group("leaf").alias("g")).agg(F.lit(0).alias("q"), F.count("*").alias("p"))
    sizes = asks.unionByName(has).groupBy("dim", "g").agg(F.sum("q").alias("q"), F.sum("p").alias("p")).collect()  # one row an inner node
    table = [(r["dim"], r["g"], max(1, -(-r["p"] // POINT_BLOCK)), max(1, -(-r["q"] // QUERY_BLOCK))) for r in sizes]
    blocks = F.broadcast(spark.createDataFrame(table, "dim int, g long, pb int, qb int"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part_of = lambda c: F.pmod(F.xxhash64("c"), F.col(c)).cast("int")
    by = ["dim", "g", "pn", "qn"]
    asked = routed.select("dim", "c", "v", "leaves", F.explode(F.array_distinct(F.transform("leaves", group))).alias("g"))
    asked = asked.select("dim", "g", "c", "v", F.filter("leaves", lambda x: group(x) == F.col("g")).alias("leaves"))
    side_q = asked.join(blocks, ["dim", "g"]).select("dim", "g", upto("pb").alias("pn"), part_of("qb").alias("qn"), "c", "v", "leaves")
    points = routed.select(*[F.col(x).alias(f"_{x}") for x in routed.columns]).toDF(*routed.columns)  # attributes of their own
    side_p = points.withColumn("g", group("leaf")).join(blocks, ["dim", "g"]).select("dim", "g", part_of("pb").alias("pn"), upto("qb").alias("qn"), "ids", "v", "leaf")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            d = left["dim"][0].as_py()
            q, p = _vectors(left["v"], d), _vectors(right["v"], d)
            ids = right["ids"].combine_chunks()
            names = _order([x[0] for x in ids.to_pylist()])
            lists = left["leaves"].combine_chunks()
            asked_by = np.repeat(np.arange(len(q)), np.diff(np.asarray(lists.offsets)))
            asked_for, home = np.asarray(lists.flatten()), right["leaf"].to_numpy()
            for leaf in np.unique(home):
                who, there = asked_by[asked_for == leaf], np.flatnonzero(home == leaf)
                if len(who):
                    r, c, s = _best(q[who], p[there], names[there], k, least)
                    parts.append((who[r], there[c], s))
        if not parts:
            return pa.table({"c": pa.array([], pa.string()), "ids": pa.array([], pa.list_(pa.string())), "s": pa.array([], pa.float64())})
        r, c, s = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = _first(r, c, s, names, k)
        return pa.table({"c": left["c"].combine_chunks().take(pa.array(r[keep])), "ids": ids.take(pa.array(c[keep])), "s": pa.array(s[keep])})

    return side_q.groupBy(*by).cogroup(side_p.groupBy(*by)).applyInArrow(compare, "c string, ids array<string>, s double")
