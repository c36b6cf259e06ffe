"""Groups of linked records by minimum-edge contraction, and splits that keep groups together (problem 4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymint.session import BROADCAST_BYTES, checked_broadcast, cut, drop, skew_join

#: Bytes that a label and its component may take in a broadcast table.
LABEL_BYTES = 64
#: A group with at least total / LARGE rows is placed by itself; there are at most LARGE of them.
LARGE = 1000
#: Hash buckets by which the roots of a size band are laid end to end; at least one for so many rows.
BUCKETS, BUCKET_ROWS = 256, 1_000_000


def star_edges(links: DataFrame) -> DataFrame:
    """Edges (a, b; a < b) that connect the members of every link value, from ``links`` (key, node): each member to the
    least one, so as many edges as members. The members of a hot value are spread over several tasks."""
    hubs = links.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).where(F.col("n") > 1).select("key", "a")
    return skew_join(links, hubs, ["key"], F.col("node")).where(F.col("node") > F.col("a")).select("a", F.col("node").alias("b")).distinct()


def _renamed(many: DataFrame, step: DataFrame, on: str, to: str, spread: Column) -> DataFrame:
    """``many`` with the label that ``step`` (c, p) gives to its column ``on`` as ``to``; null where it has none. A step of
    few components is broadcast by its counted size, else hot labels are spread."""
    named = step.select(F.col("c").alias(on), F.col("p").alias(to))
    if step.counted["rows"] * LABEL_BYTES <= BROADCAST_BYTES:
        return many.join(F.broadcast(named), on, "left")
    return skew_join(many, named, [on], spread, "left")


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (node, root) of the nodes of ``edges`` (a, b), root the least node; and the forest (a, b) that spans them.

    Borůvka rounds: every component takes its least edge to another one, with edges ordered by (a, b), so that what is
    taken has no cycle but pairs that took the same edge. Such a pair is rooted at its smaller label, the taken edges are
    contracted by pointer doubling, and the edges are relabelled; those inside a component are gone. Components at least
    halve with each round. Labels, edges and the forest, a part a round, are written tables in the shared folder, so a lost
    executor costs a reread; what the loop asks about them is counted while they are written. Hot labels: the least edge is
    a partial aggregate, and relabelling spreads them.
    """
    rows = {"rows": F.count(F.lit(1))}
    live = cut(edges.select("a", "b", F.col("a").alias("u"), F.col("b").alias("v")), "forest-edges", counts=rows)
    forest: list[DataFrame] = []
    label: DataFrame | None = None  # node, root
    while live.counted["rows"]:
        ends = F.explode(F.array(F.struct(F.col("u").alias("c"), F.col("v").alias("to")), F.struct(F.col("v").alias("c"), F.col("u").alias("to")))).alias("x")
        both = live.select("a", "b", ends).select(F.col("x.c").alias("c"), F.struct("a", "b", F.col("x.to").alias("to")).alias("e"))
        least = cut(both.groupBy("c").agg(F.min("e").alias("e")).select("c", F.col("e.to").alias("p"), F.col("e.a").alias("a"), F.col("e.b").alias("b")), "forest-least", counts=rows)
        few = lambda df: checked_broadcast(df, least.counted["rows"], LABEL_BYTES)  # noqa: B023, E731
        forest.append(cut(least.select("a", "b").distinct(), "forest-tree"))
        back = least.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        parent = least.select("c", "p").join(few(back), "p").select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"))
        parent = cut(parent, "forest-parent", counts=rows)
        drop(least)
        moved = True
        while moved:
            up = parent.select(F.col("c").alias("p"), F.col("p").alias("g"))
            doubled = parent.join(few(up), "p").select("c", F.col("g").alias("p"), (F.col("g") != F.col("p")).alias("moved"))
            newer = cut(doubled, "forest-parent", counts={**rows, "moved": F.count_if(F.col("moved"))})
            drop(parent)
            parent, moved = newer, newer.counted["moved"] > 0
        if label is None:
            label = parent.select(F.col("c").alias("node"), F.col("p").alias("root"))
        else:
            label = cut(_renamed(label, parent, "root", "p", F.col("node")).select("node", F.coalesce("p", "root").alias("root")), "forest-labels")
        moved_edges = _renamed(_renamed(live, parent, "u", "u2", F.col("b")), parent, "v", "v2", F.col("b"))
        # of the edges between two components only the least can ever be taken
        newer = (
            moved_edges.where(F.col("u2") != F.col("v2"))
            .groupBy(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v"))
            .agg(F.min(F.struct("a", "b")).alias("e"))
            .select(F.col("e.a").alias("a"), F.col("e.b").alias("b"), "u", "v")
        )
        newer = cut(newer, "forest-edges", counts=rows)
        drop(live)
        live = newer
    if label is None:
        none = edges.select(F.col("a").alias("node"), F.col("a").alias("root")).where(F.lit(False))
        return none, edges.where(F.lit(False))
    least_node = label.groupBy("root").agg(F.min("node").alias("least"))
    return skew_join(label, least_node, ["root"], F.col("node")).select("node", F.col("least").alias("root")), reduce(DataFrame.unionByName, forest)


def linked_groups(df: DataFrame, key: str, links: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Every distinct ``key`` of ``df`` with its ``root`` (the least key of its group), and the spanning forest.

    Rows whose values agree in one of ``links`` are linked, directly or through others; a null value links nothing. The
    place of the value in ``links`` is part of it: a name never equals a family. Rows with one key are one record, with
    the links of all of them. A null key is no record and gives no row. Empty tables give empty results.
    """
    base = df.where(F.col(f"`{key}`").isNotNull())
    values = F.array(*[F.when(c.isNotNull(), F.concat(F.lit(f"{i}:"), c)) for i, c in enumerate(links)])
    pairs = base.select(F.col(f"`{key}`").alias("node"), F.explode(values).alias("value")).where(F.col("value").isNotNull())
    pairs = cut(pairs.select(F.xxhash64("value").alias("h1"), F.xxhash64(F.concat(F.lit("#"), "value")).alias("h2"), "node").select(F.struct("h1", "h2").alias("key"), "node").distinct(), "links")
    groups, forest = spanning_forest(star_edges(pairs))
    nodes = base.select(F.col(f"`{key}`").alias("node")).distinct()
    return nodes.join(groups.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("root")), forest


def deal_splits(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """``node``, ``root`` and ``split`` for ``groups`` (node, root), near the shares of ``shares`` (split, target_share).

    Roots are stratified by size band (powers of two). The few large groups (at least 1/1000 of all rows each) go, largest
    first, to the split that lacks most rows for its share. In the bands below, the roots are laid end to end in hash
    order and dealt systematically: the line of each band is divided in proportion to what the splits still lack, so every
    split gets its part of every band. The offsets come from sums by (band, hash bucket), never from one sorted task.
    Shares that are null or not positive get nothing; without any positive share the split is null.
    """
    spark = groups.sparkSession
    groups = cut(groups, "split-groups")
    sizes = cut(groups.groupBy("root").agg(F.count("*").alias("size")), "split-sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    wanted = [(r["split"], float(r["target_share"])) for r in shares.collect() if r["target_share"] and r["target_share"] > 0]
    if not wanted or not total:
        return groups.withColumn("split", F.lit(None).cast("string"))
    whole = sum(s for _, s in wanted)
    lack = {name: s / whole * total for name, s in sorted(wanted)}
    large = sizes.where(F.col("size") * LARGE >= total).orderBy(F.desc("size"), "root").collect()  # at most LARGE rows
    placed = []
    for r in large:
        name = max(lack, key=lambda s: (lack[s], s))
        lack[name] -= r["size"]
        placed.append((r["root"], name))
    rest = max(1e-9, sum(max(0.0, v) for v in lack.values()))
    bounds, so_far = [], 0.0
    for name, v in lack.items():
        so_far += max(0.0, v) / rest
        bounds.append((name, so_far))
    small = (
        sizes.where(F.col("size") * LARGE < total)
        .withColumn("band", F.floor(F.log2("size")).cast("int"))
        .withColumn("h", F.xxhash64("root", F.lit(4)))
        .withColumn("b", F.pmod("h", F.lit(max(BUCKETS, total // BUCKET_ROWS))))
    )
    per = small.groupBy("band", "b").agg(F.sum("size").alias("n"))
    line = Window.partitionBy("band").orderBy("b")
    per = per.select("band", "b", (F.sum("n").over(line) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("band")).alias("band_rows"))
    inside = Window.partitionBy("band", "b").orderBy("h", "root")
    at = small.withColumn("own", F.sum("size").over(inside) - F.col("size") / 2).join(F.broadcast(per), ["band", "b"])
    share = (F.col("before") + F.col("own")) / F.col("band_rows")
    split = F.lit(bounds[-1][0])
    for name, upto in reversed(bounds[:-1]):
        split = F.when(share < upto, name).otherwise(split)
    dealt = at.select("root", split.alias("split"))
    kind = groups.schema["root"].dataType.simpleString()
    dealt = dealt.unionByName(spark.createDataFrame(placed, f"root {kind}, split string"))
    return skew_join(groups, dealt, ["root"], F.col("node")).select("node", "root", "split")
