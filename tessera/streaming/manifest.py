"""A manifest of processed keys in buckets, with a Bloom filter for each bucket.

Keys lie in folders by a hash (``bucket=17/batch=a-5``).  A micro-batch asks the filters of the buckets that its keys
fall in; only buckets with a key that may be there are read, so new keys cost their buckets' filters alone, and what
is read follows the batch, not the manifest.  A filter is a bit file that is replaced whole and grows by doubling
when it is full; it is written before the keys are, so every key of the manifest is in it.  A missing or broken filter
says "may be" to all keys.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.shared import unused
from tessera.sources.storage import Store

BITS, HASHES, LEAST = 12, 6, 1 << 13  # bits for a key, places of a key, bits of a small filter


class Filter:
    """Bits and the number of keys that were put in (with repetitions)."""

    def __init__(self, bits: np.ndarray, n: int = 0):
        self.bits, self.n = bits, n

    @classmethod
    def for_keys(cls, n: int) -> Filter:
        size = LEAST
        while size < n * BITS:
            size *= 2
        return cls(np.zeros(size // 8, np.uint8))

    @classmethod
    def load(cls, store: Store, name: str) -> Filter | None:
        with suppress(OSError, struct.error):
            raw = store.read(name)
            n, size = struct.unpack_from("<QQ", raw)
            if len(raw) == 16 + size // 8:
                return cls(np.frombuffer(raw, np.uint8, offset=16).copy(), n)
        return None

    def save(self, store: Store, name: str) -> None:
        store.write(name, [struct.pack("<QQ", self.n, len(self.bits) * 8), self.bits.tobytes()])

    def _places(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.view(np.uint64)
        step = (h >> np.uint64(33)) | np.uint64(1)
        return ((h[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(len(self.bits) * 8 - 1)).astype(np.int64)

    def add(self, hashes: np.ndarray) -> None:
        places = self._places(hashes).ravel()
        np.bitwise_or.at(self.bits, places >> 3, (1 << (places & 7)).astype(np.uint8))
        self.n += len(hashes)

    def may_have(self, hashes: np.ndarray) -> np.ndarray:
        places = self._places(hashes)
        return ((self.bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(1)

    def full(self) -> bool:
        return self.n * BITS > len(self.bits) * 8


def _filter(bucket: int) -> str:
    return f"_filters/{bucket:05d}"


class Manifest:
    """Keys that have been processed, with a label of their batch."""

    def __init__(self, spark: SparkSession, path: str, key: str, kind: str, buckets: int = 64):
        self.spark, self.path, self.key, self.kind, self.buckets = spark, path, key, kind, buckets
        #: Buckets whose keys were read for the last batch; what a test or a log may look at.
        self.read: list[int] = []

    def _bucketed(self, keys: DataFrame) -> DataFrame:
        # another seed than the hash in the filter: a bucket's keys would agree in the filter's bits
        return keys.withColumn("_hash", F.xxhash64(self.key)).withColumn("_bucket", F.pmod(F.xxhash64(self.key, F.lit("bucket")), F.lit(self.buckets)).cast("int"))

    def _asked(self, keys: DataFrame) -> list[int]:
        """Buckets that may have one of the keys."""
        path, name = self.path, _filter

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, filters, found = Store(path), {}, set()
            for batch in batches:
                bucket, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for b in set(np.unique(bucket).tolist()) - found:
                    if b not in filters:
                        filters[b] = Filter.load(store, name(b))
                    if filters[b] is None or filters[b].may_have(hashes[bucket == b]).any():
                        found.add(b)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int32())], ["bucket"])

        rows = self._bucketed(keys).select("_bucket", "_hash").repartition(min(self.buckets, 16), "_bucket").mapInArrow(run, "bucket int")
        return sorted(r.bucket for r in rows.collect())  # the number of buckets at most

    def _known(self, buckets: list[int]) -> DataFrame | None:
        """The keys of these buckets; other buckets' folders are not even listed."""
        store = Store(self.path)
        folders = [f"{self.path}/keys/bucket={b}" for b in buckets if store.entries(f"keys/bucket={b}")]
        if not folders:
            return None
        return self.spark.read.schema(f"{self.key} {self.kind}, bucket int, batch string").option("basePath", f"{self.path}/keys").parquet(*folders)

    def new(self, rows: DataFrame, label: str) -> DataFrame:
        """Rows whose key no batch but this one has processed."""
        self.read = self._asked(rows.select(self.key))
        known = self._known(self.read)
        if known is None:
            return rows
        seen = known.filter(F.col("batch") != label).select(F.col(self.key).alias(unused(rows.columns, "_seen")))
        return rows.join(seen, rows[self.key].eqNullSafe(seen[seen.columns[0]]), "left_anti")

    def add(self, keys: DataFrame, label: str) -> None:
        """Note a batch's keys: filters first, then the keys; a repeated batch replaces its own."""
        path, name, key = self.path, _filter, self.key
        own = self._bucketed(keys.select(key))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, held = Store(path), {}
            for batch in batches:
                bucket, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for b in np.unique(bucket).tolist():
                    held.setdefault(b, []).append(hashes[bucket == b])
            full = []
            for b, parts in held.items():
                hashes = np.concatenate(parts)
                now = Filter.load(store, name(b)) or Filter.for_keys(4 * len(hashes))
                now.add(hashes)
                now.save(store, name(b))
                if now.full():
                    full.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32())], ["bucket"])

        dealt = own.select("_bucket", "_hash").repartition(min(self.buckets, 16), "_bucket")
        full = sorted(r.bucket for r in dealt.mapInArrow(run, "bucket int").collect())
        rows = own.select(key, F.col("_bucket").alias("bucket"), F.lit(label).alias("batch")).repartition(min(self.buckets, 16), "bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{self.path}/keys")
        if full:
            self._grown(full)

    def _grown(self, full: list[int]) -> None:
        """Filters of full buckets made anew, twice as large as their keys need."""
        path, name = self.path, _filter

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, held = Store(path), {}
            for batch in batches:
                bucket, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for b in np.unique(bucket).tolist():
                    held.setdefault(b, []).append(hashes[bucket == b])
            for b, parts in held.items():
                hashes = np.concatenate(parts)
                bigger = Filter.for_keys(2 * len(hashes))
                bigger.add(hashes)
                bigger.save(store, name(b))
            yield pa.RecordBatch.from_arrays([pa.array(sorted(held), pa.int32())], ["bucket"])

        hashed = self._known(full).select("bucket", F.xxhash64(self.key).alias("_hash"))
        hashed.repartition(len(full), "bucket").mapInArrow(run, "bucket int").collect()
