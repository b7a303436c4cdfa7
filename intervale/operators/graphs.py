"""Connected components of a graph of any size, as joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, *, settle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b) -> (node, root): the smallest node that each node reaches; nodes without an edge to another are left out.

    Every round each node's larger neighbours move to its smallest one, and then its
    smaller ones do, which halves long chains; minima combine before the
    shuffle, so a node of many edges is no group that has to be gathered.  Ends
    when a round changes nothing.  ``settle`` keeps a round's rows.
    """
    links = settle(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct())
    known = _digest(links)
    while True:
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        own = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(own, "hi").select(F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*")
        links = settle(small.where("hi <> lo").distinct())
        now = _digest(links)
        if now == known:
            break
        known = now
    roots = links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
