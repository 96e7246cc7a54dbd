"""Connected components of a graph held as edges, by rounds of contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.session import materialize


#: Rounds whose moves are put together before the result is written.
ROUNDS_AT_ONCE = 4
#: Edges that one task joins; more go through rounds until no more are left.
FEW = 50_000


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of ``edges`` (a, b: longs); nodes of one component share a root.

    In each round every node moves to the neighbour (or itself) that a hash of the
    round puts first, and edges follow; fresh hashes shrink paths and stars alike, so
    rounds grow with the logarithm of the nodes. The first in each neighbourhood is a
    combinable minimum, so no neighbourhood is held by one task. Each round is a written
    table. Moves are put together from the last round, the smallest, to the first, and written
    every few rounds; no join here sends a side through the driver.
    """
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct())
    nodes, steps = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), []
    while (left := edges.count()) > FEW:
        turn = len(steps) + 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("at"))  # noqa: B023, E731
        seen = edges.select("a", "b").union(edges.select("b", "a"))
        moves = seen.groupBy("a").agg(F.min(F.least(rank("a"), rank("b"))).alias("m")).select("a", F.col("m.at").alias("to"))
        moves = materialize(moves)
        own = moves.select(F.col("a"), F.col("to").alias("ta")).hint("merge")
        other = moves.select(F.col("a").alias("b"), F.col("to").alias("tb")).hint("merge")
        moved = edges.join(own, "a").join(other, "b").where("ta != tb")
        edges = materialize(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        steps.append(moves.select(F.col("a").alias("node"), F.col("to").alias("root")))
    if left:
        steps.append(materialize(_in_one_task(edges)))
    if not steps:
        return materialize(nodes.withColumn("root", F.col("node")))
    placed = steps.pop()
    while steps:
        for _ in range(ROUNDS_AT_ONCE):
            if steps:
                placed = _led_on(steps.pop(), placed)
        placed = materialize(placed)
    return placed


def _in_one_task(edges: DataFrame) -> DataFrame:
    """node, root of a few edges: each root is the least node of its component."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([batch.column(k).to_numpy() for k in range(2)], axis=1) for batch in batches]
        if not parts:
            return
        node, at = np.unique(np.concatenate(parts), return_inverse=True)
        a, b = at.reshape(-1, 2).T
        root = np.arange(len(node))
        while True:
            x, y = root[a], root[b]
            if (x == y).all():
                break
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[root])], ["node", "root"])

    return edges.coalesce(1).mapInArrow(joined, "node long, root long")


def _led_on(placed: DataFrame, further: DataFrame) -> DataFrame:
    """(node, root) of ``placed`` with roots replaced by their own root in ``further``, where they have one."""
    onward = further.select(F.col("node").alias("root"), F.col("root").alias("to")).hint("merge")
    return placed.join(onward, "root", "left").select("node", F.coalesce("to", "root").alias("root"))


def extended(placed: DataFrame, edges: DataFrame) -> DataFrame:
    """The components of ``placed`` (node, root) joined by further ``edges`` (a, b), which may name new nodes.

    Only edges between different components go on, so the work grows with them.
    """
    root = placed.hint("merge")
    rooted = edges.join(root.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
    rooted = rooted.join(root.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    joined = components(rooted.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    new = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().join(root.select("node"), "node", "left_anti")
    return materialize(_led_on(placed.unionByName(new.withColumn("root", F.col("node"))), joined))
