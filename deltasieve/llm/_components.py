"""Connected components of an edge table, in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ._common import discard, stash

#: Nodes with more neighbours than this, and than their share of the edges below, are hubs: at most so many are broadcast.
HUB, MOST_HUBS = 20_000, 50_000
#: Edges that a task draws together at once.
HELD = 1_000_000
#: No more edges than these are drawn together in one task, in place of rounds.
FEW = 10_000


def _lowest(edges: DataFrame, least: DataFrame, size: int) -> DataFrame:
    """edges (a, b) with m from least (u, m, n; n neighbours), matched on a = u.

    A hub's edges aren't dealt by its number, which would put all of them into one task: hubs are so few (no more than
    MOST_HUBS, as each has at least that share of the edges) that they are broadcast. Of no more than HUB edges, none has so many.
    """
    limit = max(HUB, size // MOST_HUBS)
    if size <= limit:
        return edges.join(least.select("u", "m"), F.col("a") == F.col("u")).select("a", "b", "m")
    hubs = F.broadcast(least.where(F.col("n") > limit).select(F.col("u").alias("hub"), F.col("m").alias("hub_m")))
    marked = edges.join(hubs, edges["a"] == F.col("hub"), "left")
    far = marked.where("hub IS NOT NULL").select("a", "b", F.col("hub_m").alias("m"))
    near = marked.where("hub IS NULL").select("a", "b").join(least.where(F.col("n") <= limit).select("u", "m"), F.col("a") == F.col("u")).select("a", "b", "m")
    return near.unionByName(far)


def drawn_together(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of these edges' nodes that aren't themselves the least."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        new = p != q
        if not new.any():
            break
        x, y, p, q = x[new], y[new], p[new], q[new]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    some = root != np.arange(len(nodes))
    return nodes[some], nodes[root[some]]


def _stars(batches: Iterator) -> Iterator:
    """Edges (a, b) in place of a task's own, some at a time: each node with the least one that these lead it to."""
    import pyarrow as pa

    def drawn(held: list) -> pa.RecordBatch:
        a, b = drawn_together(*(np.concatenate(c) for c in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    held, size = [], 0
    for batch in batches:
        held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")])
        size += batch.num_rows
        if size > HELD:
            yield drawn(held)
            held, size = [], 0
    if held:
        yield drawn(held)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for every node of edges (a, b bigint); root is the component's smallest node.

    Large-star and small-star steps in turn: each node's larger neighbours, then its smaller ones, are linked to the
    smallest node around it. Neither gathers a node's neighbours; each takes a minimum and a join. A round's edges
    are written to the shared folder, in place of those of the round before. The edges become stars after a number of
    rounds that is logarithmic in practice; if they haven't by the last round allowed, an error is raised rather than a
    partial result given. Before the first round each task draws its own edges together, and once more those that it is dealt of
    what is left, so that few rounds are left; up to FEW edges that are left by then are drawn together at once. Links from a node to itself and repeated links change nothing; no edges give no rows.
    """
    linked = edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).where("a <> b")
    drawn = lambda e: e.mapInArrow(_stars, "a bigint, b bigint").distinct()
    now, size = _written(drawn(drawn(linked)))
    if size[0] <= min(FEW, HUB):
        stars = stash(now.coalesce(1).mapInArrow(_stars, "a bigint, b bigint"), "edges")
        discard(now)
        return _rooted(stars)
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
        large = _lowest(both, least, 2 * size[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _lowest(large, low, 2 * size[0]).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after, grown = _written(small.select("e.a", "e.b").where("a <> b").distinct())
        discard(now)
        if grown == size:
            return _rooted(after)
        now, size = after, grown
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _rooted(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select("b", "b").distinct())


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """edges (a, b), stashed, with their number and two sums of hashes that tell them apart, taken as they are written."""
    seen = Observation()
    sums = F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)")).alias("s")
    found = stash(edges.observe(seen, *sums), "edges")
    return found, tuple(seen.get[c] for c in "nxs")
