"""What the registered queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on(*names: str):
    """A query that gets the named tables."""

    def wrap(f: Callable[..., DataFrame]) -> Query:
        return lambda spark, sf_dir: f(*(table(spark, sf_dir, n) for n in names))

    return wrap
