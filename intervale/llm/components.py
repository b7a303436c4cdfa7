"""Connected components of an undirected graph, as DataFrame passes.

Alternating large-star and small-star rounds: every round each node hands its
neighbours to the smallest one, so paths halve and a component of any shape
ends as a star around its smallest node.  Edges of a hub are aggregated before
the shuffle and joined with one row per node, which adaptive execution splits.
Rounds go on until no more edges are left than one task takes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervale.llm.runtime import Scratch

MAX_ROUNDS = 60
#: Edges that one task settles, of 16 bytes each.
ONE_TASK = 1 << 20


def settle_pairs(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node) of the components of the given pairs."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = label != np.arange(len(nodes))
    return nodes[out], nodes[label[out]]


def components(edges: DataFrame, scratch: Scratch, label: str = "components") -> DataFrame:
    """(u, v) long pairs in any order -> (node, root): each linked node with its component's smallest.

    Loops and repeated edges are ignored; an edge with a null end is dropped.
    An empty input gives an empty result.
    """
    pairs = edges.where("u != v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    now = scratch.table(pairs.distinct(), f"{label}-0")
    mark = _mark(now)
    for turn in range(1, MAX_ROUNDS):
        if mark[0] <= ONE_TASK:
            return _settled(now)
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = now.join(least, now.a == least.u).select(F.col("m").alias("a"), "b").where("a != b").distinct()
        lowest = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(lowest, "b").select("m", "a", "b")
        after = small.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a != b").distinct()
        after = scratch.table(after, f"{label}-{turn}")
        scratch.free(f"{label}-{turn - 1}")
        previous, mark, now = mark, _mark(after), after
        if mark == previous:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    leaves = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return leaves.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _settled(edges: DataFrame) -> DataFrame:
    """(node, root) of at most ONE_TASK edges."""

    def settle(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        a, b = (np.concatenate(x) for x in zip(*got, strict=True)) if got else [np.zeros(0, np.int64)] * 2
        node, root = settle_pairs(a, b)
        own = np.unique(root)
        yield pa.record_batch({"node": np.concatenate((node, own)), "root": np.concatenate((root, own))})

    return edges.select("a", "b").coalesce(1).mapInArrow(settle, "node long, root long")


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)")).alias("s")).first()
    return row.n, row.x, row.s
