"""The bucketed manifest: nothing twice, and batches that read what they may hit alone."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources.storage import Store
from tessera.streaming.incremental import process_new
from tessera.streaming.manifest import Filter, Manifest


def test_filters():
    rng = np.random.default_rng(1)
    put, other = rng.integers(-(2**63), 2**63 - 1, (2, 20_000))
    f = Filter.for_keys(len(put))
    f.add(put)
    assert f.may_have(put).all() and f.may_have(other).mean() < 0.02 and not f.full()
    f.add(other)
    assert f.may_have(put).all() and f.full()


def test_filters_are_files(tmp_path):
    store, f = Store(str(tmp_path)), Filter.for_keys(10)
    f.add(np.arange(10))
    f.save(store, "x/1")
    got = Filter.load(store, "x/1")
    assert got.n == 10 and (got.bits == f.bits).all() and Filter.load(store, "x/2") is None
    store.write("x/3", [store.read("x/1")[:-5]])
    assert Filter.load(store, "x/3") is None


def test_new_keys_read_no_buckets(spark, tmp_path):
    ledger = Manifest(spark, str(tmp_path), "k", "string", 8)
    batch = lambda i: spark.range(i * 300, i * 300 + 300).select(F.concat(F.lit("key"), "id").alias("k"), "id")
    read = []
    for i in range(6):  # filters grow on the way
        fresh = ledger.new(batch(i), f"s-{i}")
        assert fresh.count() == 300
        read.append(len(ledger.read))
        ledger.add(fresh, f"s-{i}")
    assert sum(read) <= 16  # of 6 x 8; false alarms only
    again = ledger.new(batch(2).limit(1).union(batch(9).limit(1)), "s-9")
    assert [r.id for r in again.collect()] == [2700] and 1 <= len(ledger.read) <= 2
    assert ledger.new(batch(2), "s-2").count() == 300  # its own batch again
    ledger.add(batch(2), "s-2")
    keys = spark.read.parquet(f"{tmp_path}/keys")
    assert keys.count() == 1800 == keys.select("k").distinct().count()
    os.remove(f"{tmp_path}/_filters/00003")
    assert ledger.new(batch(1), "s-9").count() == 0


def test_a_failed_batch_is_made_again(spark, tmp_path):
    df = spark.createDataFrame([(i % 7, f"v{i}") for i in range(50)] + [(None, "n")], "k long, v string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")

    def run(process):
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        process_new(stream, process, f"{tmp_path}/out", f"{tmp_path}/manifest", "k", f"{tmp_path}/checkpoint", 4).awaitTermination()

    def broken(rows):
        raise ValueError("no result")

    with pytest.raises(Exception, match="no result"):
        run(broken)
    for _ in range(2):
        run(lambda rows: rows)
    got = spark.read.parquet(f"{tmp_path}/out").select("k", "v").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(k, min(f"v{i}" for i in range(50) if i % 7 == k)) for k in range(7)] + [(None, "n")], key=str)
