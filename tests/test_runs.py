"""Folds over keys that lie in several parts, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import runs, workplan


@pytest.fixture(params=[2, 13])
def parts(spark, request):
    """Sorted tables in so many parts, however small."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, (str(request.param), "false"), strict=True):
        spark.conf.set(n, v)
    yield request.param
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def log(seed, n=1500):
    """One key has most rows; some have one; times and orders repeat."""
    rng = random.Random(seed)
    keys = ["hot"] * 12 + ["b", "c", None, "d"]
    rows = [(rng.choice(keys), i, rng.randrange(n * 3), rng.random() < 0.25, None if rng.random() < 0.1 else rng.uniform(-5, 5), rng.choice([None, 0, 1, 5, 60, 90, 400])) for i in range(n)]
    return rows + [("once", n, 5, True, None, 7), ("all", n + 1, 6, False, 1.0, 0)]


KINDS = "key string, seq long, s long, ok boolean, value double, size long"


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return {k: sorted(v, key=lambda r: r[1]) for k, v in out.items()}


def test_means(spark, parts):
    rows = log(parts)
    got = {r.key: (r.n, r.ema) for r in workplan.ema(spark.createDataFrame(rows, KINDS), "key", "seq", "value").collect()}
    want = {}
    for k, own in by_key(rows).items():
        x = None
        for r in own:
            if r[4] is not None:
                x = r[4] if x is None else 0.9 * x + 0.1 * r[4]
        want[k] = (len(own), x)
    assert got.keys() == want.keys()
    for k, (n, x) in want.items():
        assert got[k][0] == n and (got[k][1] is None if x is None else abs(got[k][1] - x) < 1e-9)


@pytest.mark.parametrize("run, stop", [(1, 3), (4, 2), (7, 40), (300, 3)])
def test_breaker(spark, parts, run, stop):
    rows = [(k, q, t, ok and q % 5 == 0, v, z) for k, q, t, ok, v, z in log(run + parts)]
    df = spark.createDataFrame(rows, KINDS).withColumns({c: F.lit(1) for c in ("_part", "_pos", "_own")})
    got = workplan.circuit_breaker(df, "key", "seq", "ok", run, stop)
    assert got.columns == [*df.columns, "trip"]
    want = []
    for k, own in by_key(rows).items():
        streak = trips = 0
        for r in own:
            if trips >= stop:
                break
            streak = 0 if r[3] else streak + 1
            trip = not r[3] and streak % run == 0
            trips += trip
            want.append((k, r[1], trip))
    assert sorted(map(tuple, got.select("key", "seq", "trip").collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("ttl", [1, 17, 400, 100_000])
def test_leases(spark, parts, ttl):
    rows = log(ttl)
    want = []
    for k, own in by_key(rows).items():
        last = None
        for t in sorted(r[2] for r in own):
            if last is None or t - last >= ttl:
                last = t
                want.append((k, t))
    assert sorted(map(tuple, workplan.lease_grants(spark.createDataFrame(rows, KINDS), "key", "s", ttl).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("limit, header", [(100, 0), (100, 7), (5000, 40), (1, 0), (10**9, 0)])
def test_batches(spark, parts, limit, header):
    rows = log(limit + header)
    want = []
    for k, own in by_key(rows).items():
        batch, used, n = 0, header, 0
        for r in own:
            z = r[5] or 0
            if n and used + z > limit:
                batch, used, n = batch + 1, header, 0
            used, n = used + z, n + 1
            want.append((k, r[1], z, batch))
    got = workplan.batch_by_bytes(spark.createDataFrame(rows, KINDS), "key", "seq", "size", limit, header)
    assert got.columns == ["key", "seq", "size", "batch"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_the_hot_key_is_in_several_parts(spark, parts):
    df = spark.createDataFrame(log(1), KINDS)
    rows = runs.in_parts(df.select("key", F.col("s").alias("at")), ["key", "at"], "part", "pos")
    assert runs.Spans(rows, "key", False).most > 1


def test_ways_within_a_segment():
    rng = np.random.default_rng(1)
    at = np.sort(rng.integers(0, 500, 300))
    segment = runs.Segment(at, at + rng.integers(-5, 40, 300))
    until, count = segment.ways()
    for i in range(300):
        way = [i]
        while (j := next((j for j in range(way[-1] + 1, 300) if at[j] >= segment.until[way[-1]]), None)) is not None:
            way.append(j)
        assert (until[i], count[i]) == (segment.until[way[-1]], len(way)) and segment.starts(i).tolist() == way


def test_no_rows(spark):
    df = spark.createDataFrame([], KINDS)
    assert workplan.ema(df, "key", "seq", "value").collect() == workplan.lease_grants(df, "key", "s").collect() == []
    assert workplan.circuit_breaker(df, "key", "seq", "ok").collect() == workplan.batch_by_bytes(df, "key", "seq", "size", 5).collect() == []
