"""Audits of a growing table from mergeable sketches kept for each part of it.

Of each part (a day, a snapshot) one row is stored: exact numbers of rows and nulls, and for each column a HyperLogLog
sketch of its values, a sketch of its commonest ones, and for numbers a KLL sketch of their order.  A report merges
these rows and reads no old data; a part that comes again replaces its row.  Errors, as the sketches promise them:
distinct values within about 3 x 0.8 / sqrt(2**lg) of their number (2 % for 14), the rank of a quantile within about
1.5 % for k = 200, and a value's count within rows / (0.75 x items) (exact while values fit the items).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sketched(df: DataFrame, part: str, values: Sequence[str], numbers: Sequence[str] = (), lg: int = 14, k: int = 200, items: int = 1024) -> DataFrame:
    """A row for each part: part, rows, and of each column its nulls and sketches."""
    cells = [F.count("*").alias("rows")]
    for c in values:
        text = F.col(c).cast("string")
        cells += [F.count(F.when(F.col(c).isNull(), 1)).alias(f"{c}_null"), F.hll_sketch_agg(text, lg).alias(f"{c}_hll"), F.expr(f"approx_top_k_accumulate(cast(`{c}` as string), {items})").alias(f"{c}_top")]
    for c in numbers:
        cells += [F.kll_sketch_agg_double(F.col(c).cast("double"), k).alias(f"{c}_kll")]
    return df.groupBy(F.col(part).cast("string").alias("part")).agg(*cells)


class Audit:
    """Stored sketches of a table's parts."""

    def __init__(self, spark: SparkSession, path: str, part: str, values: Sequence[str], numbers: Sequence[str] = (), lg: int = 14, k: int = 200, items: int = 1024):
        self.spark, self.path, self.part, self.values, self.numbers = spark, path, part, list(values), list(numbers)
        self.size = {"lg": lg, "k": k, "items": items}

    def add(self, rows: DataFrame) -> None:
        """Sketch the parts of these rows; each must come whole, and replaces what was kept of it."""
        made = sketched(rows, self.part, self.values, self.numbers, **self.size)
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)

    def _kept(self, where: str | None) -> DataFrame:
        kept = self.spark.read.parquet(self.path).withColumn("part", F.col("part").cast("string"))
        return kept.filter(where) if where else kept

    def distinct(self, where: str | None = None) -> DataFrame:
        """field, rows, missing, distinct (about) of each column; ``where`` chooses parts."""
        kept = self._kept(where)
        cells = [F.struct(F.lit(c).alias("field"), F.sum("rows").alias("rows"), F.sum(f"{c}_null").alias("missing"), F.hll_sketch_estimate(F.hll_union_agg(f"{c}_hll")).alias("distinct")) for c in self.values]
        return kept.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))

    def commonest(self, column: str, k: int = 10, where: str | None = None) -> DataFrame:
        """value, n (about) of the commonest values."""
        top = self._kept(where).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(`{column}_top`, {self.size['items']}), {k})").alias("_t"))
        return top.select(F.explode("_t").alias("_t")).select(F.col("_t.item").alias("value"), F.col("_t.count").alias("n"))

    def quantiles(self, column: str, ranks: Sequence[float], where: str | None = None) -> DataFrame:
        """rank, value (about) of a column of numbers."""
        merged = self._kept(where).agg(F.kll_merge_agg_double(f"{column}_kll").alias("_k"))
        cells = [F.struct(F.lit(float(r)).alias("rank"), F.kll_sketch_get_quantile_double("_k", F.lit(float(r))).alias("value")) for r in ranks]
        return merged.select(F.inline(F.array(*cells)))
