"""Reproducible stratified splits that stay as they are when rows arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.shared import unused


def hash_ranks(rows: DataFrame, cls: str, key: str, seed: int, size: str, rank: str) -> DataFrame:
    """Rows with the number of rows of their class and their rank in it (from 1), by the md5 of seed and key, then key.

    A class is cut by the first digits of the hash into up to 65,536 parts that are ranked apart and start after
    the rows before them, so a class with a third of all rows is no single task. Null is a class of its own.
    """
    h, part, n, before = (unused([*rows.columns, size, rank], x) for x in ("_h", "_part", "_n", "_before"))
    rows = rows.withColumn(h, F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))))
    rows = rows.withColumn(part, F.left(h, F.lit(4)))
    w = Window.partitionBy(cls)  # over the counts of the parts
    counts = rows.groupBy(cls, part).agg(F.count("*").alias(n))
    counts = counts.select(F.col(cls).alias(f"{cls}{before}"), F.col(part).alias(f"{part}{before}"), F.sum(n).over(w).alias(size), (F.sum(n).over(w.orderBy(part)) - F.col(n)).alias(before))
    got = rows.withColumn(rank, F.row_number().over(Window.partitionBy(cls, part).orderBy(h, key)).cast("long"))
    got = got.join(counts, (got[part] == counts[f"{part}{before}"]) & got[cls].eqNullSafe(counts[f"{cls}{before}"]))
    return got.withColumn(rank, F.col(rank) + F.col(before)).drop(h, part, before, f"{cls}{before}", f"{part}{before}")


def stratified_split(df: DataFrame, key: str, cls: str, seed: int = 42, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """(key, class, split): of each class's n keys, max(1, floor(train*n)) train, floor(val*n) val, the rest test.

    Keys are taken once and ordered by the md5 of seed and key. Products are of doubles, floored.
    """
    n, rn = (unused([key, cls], x) for x in ("_size", "_rank"))
    rows = hash_ranks(df.select(key, cls).distinct(), cls, key, seed, n, rn)
    a = F.greatest(F.lit(1), F.floor(F.col(n) * F.lit(float(train))))
    b = F.floor(F.col(n) * F.lit(float(val)))
    return rows.select(key, cls, F.when(F.col(rn) <= a, "train").when(F.col(rn) <= a + b, "val").otherwise("test").alias("split"))


def stable_split(df: DataFrame, existing: DataFrame, key: str, cls: str, **options) -> DataFrame:
    """As stratified_split, but keys with an assignment keep it; new ones are ranked among themselves."""
    new = df.join(existing.select(key), key, "left_anti")
    kept = df.select(key, cls).distinct().join(existing.select(key, "split"), key)
    return kept.select(key, cls, "split").unionByName(stratified_split(new, key, cls, **options))
