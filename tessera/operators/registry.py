"""A stored registry that is kept up: rows by key in buckets, of which an upsert rewrites those it touches.

A bucket's rows lie in a folder of the version that wrote them; ``_versions/<n>`` says for each bucket which version
is its present one and appears in one step, so readers see an upsert whole or not at all, and two that are made at
once don't lose each other's rows: the second one finds its number taken and is made again on the new state.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.tables import upsert_registry
from tessera.sources.storage import Store


class Registry:
    def __init__(self, spark: SparkSession, path: str, key: str, kind: str, scalars: dict[str, str], arrays: dict[str, str], buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.scalars, self.arrays, self.store = list(scalars), list(arrays), Store(path)
        self.schema = T.StructType.fromDDL(", ".join(f"{n} {k}" for n, k in {key: kind, **scalars, **arrays}.items()))

    def _state(self) -> tuple[int, dict[int, str]]:
        """The number of the present state, and the folder of each bucket that has rows."""
        names = [n for n, _ in self.store.entries("versions")]
        return (int(names[-1]), {int(b): f for b, f in json.loads(self.store.read(f"versions/{names[-1]}")).items()}) if names else (-1, {})

    def _rows(self, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def read(self) -> DataFrame:
        return self._rows(sorted(self._state()[1].values()))

    def upsert(self, entries: DataFrame, seq: str) -> list[int]:
        """Add entries (key, scalars, arrays, seq): a key that is there keeps its scalars, its arrays grow by what is new.

        Returns the buckets that were rewritten; the others' files stay as they are.
        """
        columns = [self.key, *self.scalars, *self.arrays]
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        new = entries.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema), F.struct(F.lit(1).alias("_old"), F.col(seq).alias("_seq")).alias("_seq")).persist()
        try:
            touched = sorted(r[0] for r in new.select(bucket.alias("b")).distinct().collect())  # the number of buckets at most
            while touched:
                number, state = self._state()
                none = F.lit(None).cast(new.schema["_seq"].dataType["_seq"].dataType)
                old = self._rows([state[b] for b in touched if b in state]).withColumn("_seq", F.struct(F.lit(0).alias("_old"), none.alias("_seq")))
                whole = upsert_registry(old.unionByName(new), self.key, "_seq", self.scalars, self.arrays).select(*columns, bucket.alias("bucket"))
                version = f"v{number + 1:06d}-{uuid.uuid4().hex[:8]}"
                whole.repartition(min(self.buckets, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{version}")
                state |= {b: f"{version}/bucket={b}" for b in touched}
                if self.store.create(f"versions/{number + 1:08d}", json.dumps(state).encode()):
                    break
            return touched
        finally:
            new.unpersist()
