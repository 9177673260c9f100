"""Labels, class weights and sampling weights of a training table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.splits import hash_ranks


def class_index(tables: Sequence[DataFrame], cls: str) -> DataFrame:
    """(class, label): distinct classes of all tables, sorted, numbered from 0. One window over the class list."""
    rows = tables[0].select(cls)
    for t in tables[1:]:
        rows = rows.union(t.select(cls))
    rows = rows.filter(F.col(cls).isNotNull()).distinct()
    return rows.select(cls, (F.row_number().over(Window.orderBy(cls)) - 1).alias("label"))


def class_ids(tables: Sequence[DataFrame], slug: str) -> DataFrame:
    """(source, slug, class_id): sorted slugs of the first table, then of the next; ids by (source, slug)."""
    rows = None
    for i, t in enumerate(tables):
        part = t.select(F.lit(i).alias("source"), F.col(slug)).distinct()
        rows = part if rows is None else rows.union(part)
    return rows.select("source", slug, (F.row_number().over(Window.orderBy("source", slug)) - 1).alias("class_id"))


def class_counts(df: DataFrame, cls: str, index: DataFrame) -> DataFrame:
    """(class, label, n) for every class of the index, zeros kept."""
    n = df.groupBy(cls).agg(F.count("*").alias("n"))
    return index.join(n, cls, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_weights(counts: DataFrame, n: str = "n") -> DataFrame:
    """Inverse frequencies 1/(n + 1e-6), scaled to sum to the number of classes."""
    w = F.lit(1.0) / (F.col(n) + F.lit(1e-6))
    total = counts.agg(F.sum(w).alias("_s"), F.count("*").alias("_k"))
    return counts.crossJoin(F.broadcast(total)).withColumn("weight", w / F.col("_s") * F.col("_k")).drop("_s", "_k")


def sampling_weights(df: DataFrame, cls: str) -> DataFrame:
    """Rows with the chance of a draw: 1/n of the class, over the sum of all."""
    n = df.groupBy(cls).agg(F.count("*").alias("_n"))
    k = n.agg(F.count("*").alias("_k"))
    return df.join(n, cls).crossJoin(F.broadcast(k)).withColumn("draw_chance", F.lit(1.0) / F.col("_n") / F.col("_k")).drop("_n", "_k")


def drawn(seed: int, draw: str, below: str) -> Column:
    """A number under ``below`` for each draw: the first 15 digits of the md5 of 'seed:draw', as a number, modulo."""
    return F.pmod(F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}:"), F.col(draw).cast("string"))), F.lit(15)), 16, 10).cast("bigint"), F.col(below))


def balanced_sample(df: DataFrame, cls: str, key: str, draws: int, seed: int = 42) -> DataFrame:
    """``draws`` rows with replacement, classes equally likely: draw, key, class.

    A draw picks a class and a place in it by hashes of the seed and its number; rows of a class are numbered by the
    md5 of seed and key, in parts, and rows that share class and key count once. Rows without a class are not drawn.
    """
    rows = hash_ranks(df.select(key, cls).filter(F.col(cls).isNotNull()).distinct(), cls, key, seed, "_n", "_i")
    index = class_index([df], cls).join(rows.groupBy(cls).agg(F.max("_n").alias("_n")), cls)  # the class list
    k = index.agg(F.count("*").alias("_k"))
    pick = df.sparkSession.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(k)).withColumn("label", drawn(seed, "draw", "_k"))
    pick = pick.join(index, "label").withColumn("_i", drawn(seed + 1, "draw", "_n") + 1)
    return pick.select("draw", cls, "_i").join(rows.select(key, cls, "_i"), [cls, "_i"]).select("draw", key, cls)
