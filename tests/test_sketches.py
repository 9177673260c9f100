"""Sketches of parts against exact figures."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tessera.operators.sketches import Audit


def test_merged_sketches(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"d{rng.randrange(5)}", None if i % 11 == 0 else f"v{min(int(rng.expovariate(0.01)), 900)}", i, rng.gauss(0, 1) if i % 7 else None) for i in range(20_000)]
    df = spark.createDataFrame(rows, "day string, c string, id long, x double")
    kept = Audit(spark, f"{tmp_path}/a", "day", ["c", "id"], ["x"])
    kept.add(df.filter("day < 'd3'"))
    kept.add(df.filter("day >= 'd3'"))
    kept.add(df.filter("day = 'd1'"))  # a part that comes again
    got = {r.field: r for r in kept.distinct().collect()}
    assert (got["c"].rows, got["c"].missing, got["id"].missing) == (20_000, sum(r[1] is None for r in rows), 0)
    for c, i in (("c", 1), ("id", 2)):
        exact = len({r[i] for r in rows} - {None})
        assert abs(got[c].distinct - exact) <= 0.02 * exact + 1
    counts = Counter(r[1] for r in rows if r[1])
    top = kept.commonest("c", 5).collect()
    assert all(abs(r.n - counts[r.value]) <= 20_000 / (0.75 * 1024) for r in top if r.value is not None) and len(top) == 5
    x = sorted(r[3] for r in rows if r[3] is not None)
    for r in kept.quantiles("x", [0.01, 0.5, 0.99]).collect():
        assert abs(sum(v <= r.value for v in x) / len(x) - r.rank) < 0.02
    day = kept.distinct("part = 'd2'").filter("field = 'c'").first()
    assert day.rows == sum(r[0] == "d2" for r in rows)
    small = Audit(spark, f"{tmp_path}/b", "day", ["c"], lg=8, items=64)
    small.add(df)
    assert small.distinct().filter(F.col("distinct") > 0).count() == 1
