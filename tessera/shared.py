"""Results kept in the folder that the whole cluster sees, and names for helper columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Where that is unset, as in tests, below one temporary folder of a local session; a cluster must name it.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.conf.get("spark.master", "local").startswith("local") or "cluster" in spark.conf.get("spark.master", "local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="tessera-"))
        top = _OWN[0]
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, path: str) -> DataFrame:
    """The frame as Parquet in the shared folder, read again: later stages don't repeat the work."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(columns: Iterable[str], name: str) -> str:
    """This name, longer where a column has it in any case: helper columns never meet a caller's."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
