"""Streams in any order against the batch forms, and state that ends."""

import random

from pyspark.sql import functions as F

from tessera.operators import workplan
from tessera.streaming import ordered

KINDS = "seq long, key string, s long, ok boolean, value double"


def log(n=240):
    rng = random.Random(3)
    return [(i, f"k{rng.randrange(3)}", 500 + i * 97, rng.random() < 0.4, rng.random() if rng.random() < 0.9 else None) for i in range(n)]


def stream(spark, path, rows, files=4):
    """Rows shuffled within two hours or so of each other, and one far later that releases them."""
    rng = random.Random(1)
    rows = sorted(rows, key=lambda r: r[2] + rng.uniform(-3000, 3000))
    for i in range(files):
        part = rows[len(rows) * i // files : len(rows) * (i + 1) // files]
        spark.createDataFrame(part, KINDS).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(f"{path}/in")
    for late in (0, 1):
        end = [(10**6 + late, "end", 10**7 + late * 10**7, True, 0.0)]
        spark.createDataFrame(end, KINDS).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(KINDS + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return [r for r in df.sparkSession.table(name).collect() if r.key != "end"], q


def kept(q):
    return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]


def test_shuffled_streams_give_what_batches_give(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        df = spark.createDataFrame(log(), KINDS)
        key = lambda rows: sorted(map(tuple, rows))
        got, q = run(ordered.lease_grants(stream(spark, tmp_path / "a", log()), "key", "ts", 600, "2 hours"), "ordered_leases")
        assert key(got) == key(workplan.lease_grants(df, "key", "s", 600).collect())
        assert kept(q)[-1] <= 2 < max(kept(q))  # what is left is of the key that released the others
        got, _ = run(ordered.circuit_breaker(stream(spark, tmp_path / "b", log()), "key", "ts", "seq", "ok", 3, 3, "2 hours", 10**8), "ordered_breaker")
        assert key(got) == key(workplan.circuit_breaker(df, "key", "seq", "ok", 3, 3).select("key", "seq", "trip").collect())
        got, _ = run(ordered.ema(stream(spark, tmp_path / "c", log()), "key", "ts", "seq", "value", late="2 hours", keep=10**8), "ordered_means")
        last = {}
        for r in got:
            last[r.key] = max(last.get(r.key, (0, 0)), (r.n, r.ema))
        for r in workplan.ema(df, "key", "seq", "value").collect():
            assert last[r.key][0] == r.n and abs(last[r.key][1] - r.ema) < 1e-9
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_a_silent_key_begins_anew(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        rows = [(i, "a", s, False, 1.0) for i, s in enumerate([50, 60, 70, 5000, 5010, 5020, 90_000])]
        got, _ = run(ordered.circuit_breaker(stream(spark, tmp_path, rows, 2), "key", "ts", "seq", "ok", 3, 5, "2 hours", 1000), "ordered_anew")
        assert sorted((r.seq, r.trip) for r in got) == [(0, False), (1, False), (2, True), (3, False), (4, False), (5, True), (6, False)]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_keys_share_calls(monkeypatch):
    """A bucket's keys are folded in one call, with nulls and whole numbers that doubles do not hold."""
    import pandas as pd

    class State:
        def __init__(self):
            self.x, self.timers = [], []

        exists = lambda self: bool(self.x)
        clear = lambda self: self.x.clear()
        appendValue = lambda self, v: self.x.append(v)  # noqa: E731, N815 - Spark's name
        put = update = lambda self, v: setattr(self, "x", list(v))
        registerTimer = lambda self, t: self.timers.append(t)  # noqa: E731, N815 - Spark's name
        getListState = getValueState = lambda self, name, kind: made.setdefault(name, State())  # noqa: E731, N815 - Spark's names
        getCurrentWatermarkInMs = lambda self: 1000  # noqa: E731, N815 - Spark's name

        def get(self):
            return self.x

    made = {}
    fold = ordered.Ordered(lambda k, rows, state: ([(k, o, len(rows)) for _, o, _ in rows], (1,)), ["k", "o", "n"], 10**6)
    handle = State()
    fold.init(handle)
    big = 2**60 + 1
    rows = pd.DataFrame({"_ms": [5, 4, 2000, 3], "_key": [big, 0, big, big], "_key_null": [False, True, False, False], "_order": [big, 0, 7, 1], "_order_null": [False, True, False, False], "_value": [1.5, None, 1.0, 2.0], "_value_null": [False] * 4})
    assert all(len(x) == 0 for x in fold.handleInputRows((3,), iter([rows]), handle))
    (got,) = fold.handleExpiredTimer((3,), handle, None)
    assert got.values.tolist() == [[big, 1, 2], [big, big, 2], [None, None, 1]]
    assert len(made["waiting"].x) == 1 and len(made["states"].x) == 1 and 2000 in handle.timers
