"""Bipartite host graph: edges and degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges_from_lists(df: DataFrame, src: str, items: str) -> DataFrame:
    """(src, dst) once each from an array column."""
    return df.select(F.col(src).alias("src"), F.explode(items).alias("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(side, node, degree) of both sides of distinct edges, in one aggregation."""
    e = edges.select("src", "dst").distinct()
    ends = F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).cast("string").alias("node")) for s in ("src", "dst")))
    return e.select(F.inline(ends)).groupBy("side", "node").agg(F.count("*").alias("degree"))
