"""The stored registry: equal to one upsert of everything, and rewritten where it is touched."""

import os

from pyspark.sql import functions as F

from tessera.operators import tables
from tessera.operators.registry import Registry

KINDS = "k string, seq long, name string, tags array<string>, other array<long>"


def plain(rows, keep=None):
    """Rows by key, in order of seq, after those that are kept."""
    out = dict(keep or {})
    for k, _, name, tags, other in sorted(rows, key=lambda r: r[1]):
        have = out.setdefault(k, [name, None, None])
        for i, items in ((1, tags), (2, other)):
            if items is not None:
                have[i] = have[i] or []
                have[i] += [x for j, x in enumerate(items) if x not in have[i] and x not in items[:j]]
    return out


def got(df):
    return {r.k: [r.name, r.tags, r.other] for r in df.collect()}


def entries(n, seed=0):
    return [(f"k{(i * 7 + seed) % 23}", i + seed * n, f"n{i}", [f"t{i % 5}", f"t{i % 3}", None][: i % 4], [i % 4] if i % 3 else None) for i in range(n)]


def test_one_upsert(spark):
    rows = entries(100) + [(None, 5, "x", None, []), ("only", 6, None, None, None)]
    df = spark.createDataFrame(rows, KINDS)
    assert got(tables.upsert_registry(df, "k", "seq", ["name"], ["tags", "other"])) == plain(rows)


def test_upserts_of_a_stored_table(spark, tmp_path):
    kept = Registry(spark, f"{tmp_path}/r", "k", "string", {"name": "string"}, {"tags": "array<string>", "other": "array<long>"}, 8)
    assert kept.read().count() == 0
    want = {}
    for turn in range(3):
        rows = entries(60, turn)
        kept.upsert(spark.createDataFrame(rows, KINDS).withColumn("bucket", F.lit(1)), "seq")
        want = plain(rows, want)
        assert got(kept.read()) == want
    before = dict(kept._state()[1])
    touched = kept.upsert(spark.createDataFrame([("k3", 999, "late", ["new"], None), ("fresh", 1, "f", None, None)], KINDS), "seq")
    after = kept._state()[1]
    assert 1 <= len(touched) <= 2 and {b for b in after if after[b] != before.get(b)} == set(touched)
    want = plain([("k3", 999, "late", ["new"], None), ("fresh", 1, "f", None, None)], want)
    assert got(kept.read()) == want and kept.upsert(spark.createDataFrame([], KINDS), "seq") == []


def test_two_upserts_at_once(spark, tmp_path):
    make = lambda: Registry(spark, f"{tmp_path}/r", "k", "string", {"name": "string"}, {"tags": "array<string>"}, 4)
    one, other = make(), make()
    entry = lambda tag: spark.createDataFrame([("k", 1, "n", [tag])], "k string, seq long, name string, tags array<string>")
    create, calls = one.store.create, []

    def slow(name, data):
        if not calls:
            calls.append(name)
            other.upsert(entry("b"), "seq")  # the other one is first
        return create(name, data)

    one.store.create = slow
    one.upsert(entry("a"), "seq")
    assert [sorted(r.tags) for r in one.read().collect()] == [["a", "b"]]
    assert sorted(os.listdir(f"{tmp_path}/r/versions")) == ["00000000", "00000001"]
