"""Streams against their batch forms."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import workplan
from tessera.streaming import incremental


def files(spark, tmp_path, df, order, n=3):
    """df in n files by ranges of order, read as a stream one file at a time."""
    top = df.agg(F.max(order)).first()[0] + 1
    for i in range(n):
        df.filter(f"{order} >= {top * i // n} and {order} < {top * (i + 1) // n}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def log(spark):
    rng = random.Random(3)
    return spark.createDataFrame([(i, f"k{rng.randrange(3)}", i * 97, rng.random() < 0.4, rng.random()) for i in range(240)], "seq long, key string, s long, ok boolean, value double")


def test_leases_breaker_and_mean(spark, tmp_path):
    df = log(spark)
    stream = lambda name: files(spark, tmp_path / name, df, "seq")
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(run(incremental.lease_grants(stream("a"), "key", "s", 600), "leases")) == key(workplan.lease_grants(df, "key", "s", 600))
    got = run(incremental.circuit_breaker(stream("b"), "key", "seq", "ok", 3, 3), "breaker").select("key", "seq", "trip")
    assert key(got) == key(workplan.circuit_breaker(df, "key", "seq", "ok", 3, 3).select("key", "seq", "trip"))
    got = run(incremental.ema(stream("c"), "key", "seq", "value"), "means").groupBy("key").agg(F.max_by(F.struct("n", "ema"), "n").alias("r")).select("key", "r.n", "r.ema")
    for g, w in zip(key(got), key(workplan.ema(df, "key", "seq", "value")), strict=True):
        assert g[:2] == w[:2] and abs(g[2] - w[2]) < 1e-9


def test_progress_and_windows(spark, tmp_path):
    df = log(spark).withColumn("ts", F.timestamp_seconds("s"))
    got = run(incremental.progress(files(spark, tmp_path / "a", df, "seq"), "key"), "progress", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.groupBy("key").count().collect()))
    got = run(incremental.tumbling(files(spark, tmp_path / "b", df, "seq"), "ts", "1 hour", "2 hours", "key"), "windows", "complete")
    want = df.groupBy(F.window("ts", "1 hour"), "key").count()
    assert sorted(map(tuple, got.select("window.start", "key", "n").collect())) == sorted(map(tuple, want.select("window.start", "key", "count").collect()))


def test_process_new_once(spark, tmp_path):
    df = spark.createDataFrame([(i, f"f{i % 40}") for i in range(100)], "seq long, key string")
    for _ in range(2):  # the second run finds nothing new
        stream = files(spark, tmp_path, df, "seq") if not (tmp_path / "in").exists() else spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        q = incremental.process_new(stream, lambda d: d.withColumn("size", F.length("key")), f"{tmp_path}/out", f"{tmp_path}/manifest", "key", f"{tmp_path}/checkpoint")
        q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 40
    assert spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/manifest").select("key").distinct().count() == 40


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_files_of_arriving_documents_follow_the_partitions(spark, tmp_path, monkeypatch):
    from tessera.plans import files

    monkeypatch.setattr(files, "shared_dir", lambda spark, name: f"{tmp_path}/{name}")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        got = files.stream_new(spark, "/root/testdata/sf0.001").select("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(set(got)) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id").distinct().count()
    assert len([f for f in os.listdir(tmp_path / "stream" / "in") if f.endswith(".parquet")]) == 21
