"""Connected components of a large edge list, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import blocks


#: Edges of a node from which its minimum is sent to all tasks; there are at most edges / HEAVY such nodes.
HEAVY = 100_000


def _stars(edges: DataFrame, large: bool, heavy: int) -> DataFrame:
    """edges (a > b). Large: each node's larger neighbours go to its least one; small: the smaller ones and itself.

    A star's centre may have a third of all edges, so nodes with many are no join keys.
    """
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    few = F.broadcast(low.filter(F.col("n") > heavy).select("u", "m"))
    moved = both.join(few, "u").union(both.join(few.select("u"), "u", "left_anti").join(low.select("u", "m"), "u"))
    if large:
        out = moved.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, folder: str, heavy: int = HEAVY) -> DataFrame:
    """(node, component) for all nodes with an edge; the component is its smallest node. edges: (a, b) long.

    Each round is written to the shared folder, which also cuts the lineage; the rounds grow with the
    logarithm of the longest path.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now, seen, turn = blocks.written(now, f"{folder}/round-0"), None, 0
    while True:
        turn += 1
        now = blocks.written(_stars(_stars(now, True, heavy), False, heavy), f"{folder}/round-{turn}")
        state = now.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
