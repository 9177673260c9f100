"""Properties of splits, de-duplication, weights, suppression, batches and the literal planning cases."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.numbers import iou
from tessera.operators import audit, boxes, features, pages, splits, tables, workplan

SETTINGS = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@pytest.mark.parametrize(("n", "want"), [(1, (1, 0, 0)), (2, (1, 0, 1)), (7, (4, 1, 2)), (20, (14, 3, 3)), (90, (62, 13, 15))])
def test_split_sizes(spark, n, want):
    got = {r.split: r["count"] for r in splits.stratified_split(spark.range(n).select("id", F.lit("c").alias("c")), "id", "c").groupBy("split").count().collect()}
    assert tuple(got.get(s, 0) for s in ("train", "val", "test")) == want


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 50), st.sampled_from("abc")), min_size=1, max_size=60), st.integers(0, 50))
def test_splits_are_stable(spark, rows, cut):
    rows = list({k: (k, c) for k, c in rows}.values())
    df = spark.createDataFrame(rows + rows[:3], "k int, c string")
    old = splits.stratified_split(df.filter(f"k <= {cut}"), "k", "c")
    new = splits.stable_split(df, old, "k", "c").collect()
    assert sorted(r.k for r in new) == sorted(k for k, _ in rows)
    assert {(r.k, r.split) for r in old.collect()} <= {(r.k, r.split) for r in new}
    one = splits.stratified_split(df, "k", "c").collect()
    assert all(any(r.c == c and r.split == "train" for r in one) for _, c in rows)


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 100)), min_size=1, max_size=40, unique_by=lambda r: r[1]))
def test_one_row_per_key(spark, rows):
    df = spark.createDataFrame(rows, "k int, seq int")
    last = tables.keep_last(df, "k", "seq")
    assert {tuple(r) for r in last.collect()} == {(k, max(s for j, s in rows if j == k)) for k, _ in rows}
    assert {tuple(r) for r in tables.keep_last(last, "k", "seq").collect()} == {tuple(r) for r in last.collect()}
    assert {tuple(r) for r in tables.keep_first(df, "k", "seq").collect()} == {(k, min(s for j, s in rows if j == k)) for k, _ in rows}
    ids = tables.numbered(df, ["seq"]).collect()
    assert [r.image_id for r in sorted(ids, key=lambda r: r.seq)] == list(range(1, len(rows) + 1))
    a, b = df.filter("k < 6").select("k"), df.filter("k > 3").select("k")
    diff = tables.two_way_difference(a, b, "k").collect()
    ka, kb = {k for k, _ in rows if k < 6}, {k for k, _ in rows if k > 3}
    assert {(r.k, r.only_in) for r in diff} == {(k, "left") for k in ka - kb} | {(k, "right") for k in kb - ka}


def test_numbers_of_many_rows(spark):
    """Over a million rows with payload, many partitions and ties: every number once; the same for places in a class."""
    n = 1_200_000
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.range(n, numPartitions=16).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("k"), F.md5(F.col("id").cast("string")).alias("payload"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 1000).cast("string")).alias("c"))
        out = tables.numbered(df, ["k"], "i")
        got = out.agg(F.count("*"), F.countDistinct("i"), F.min("i"), F.max("i")).first()
        assert tuple(got) == (n, n, 1, n)
        ordered = out.filter("i % 50000 = 7").orderBy("k").select("i").collect()
        assert [r.i for r in ordered] == sorted(r.i for r in ordered)
        split = splits.hash_ranks(df.select("k", "c").distinct(), "c", "k", 42, "n", "r")
        bad = split.groupBy("c").agg(F.count("*").alias("n"), F.countDistinct("r").alias("d"), F.max("r").alias("m"), F.max("n").alias("s")).filter("n <> d or n <> m or n <> s")
        assert bad.count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_folds_stream_a_large_group(spark):
    df = spark.range(200_000).select(F.lit("hot").alias("g"), F.col("id").alias("i"), (F.col("id") % 7 + 1).alias("s"))
    got = workplan.batch_by_bytes(df, "g", "i", "s", 100).groupBy("batch").agg(F.sum("s").alias("s"), F.count("*").alias("n"))
    assert got.filter("s > 100").count() == 0 and got.agg(F.sum("n")).first()[0] == 200_000
    best = workplan.best_so_far(df.withColumn("v", F.col("i").cast("double")), "i", "v", "g")
    assert best.count() == 199_999 and best.columns == ["g", "i", "s", "v"]
    odd = spark.createDataFrame([(None, 1, 5), (None, 2, None), ("a", 1, 90), ("a", 2, 20)], "g string, i int, s long")
    assert sorted(map(tuple, workplan.batch_by_bytes(odd, "g", "i", "s", 100).collect()), key=str) == sorted([(None, 1, 5, 0), (None, 2, 0, 0), ("a", 1, 90, 0), ("a", 2, 20, 1)], key=str)
    assert workplan.ema(odd, "g", "i", "s").filter("g is null").first()[1:] == (2, 5.0)


def test_annotator_falls_back(spark):
    import pandas as pd

    def detect(batch):
        if "bad" in batch["image"].tolist():
            raise ValueError
        some = batch[batch["image"] != "none"]
        return pd.DataFrame({"image": some["image"], "cx": 0.1, "cy": 0.2, "w": 0.3, "h": 0.4, "score": 0.9})

    images = spark.createDataFrame([("a",), ("bad",), ("none",), ("b",)], "image string").coalesce(1)
    got = {r.image: (r.w, r.score, r.fallback) for r in boxes.annotated(images, detect).collect()}
    assert got == {"a": (0.3, 0.9, False), "b": (0.3, 0.9, False), "bad": (1.0, None, True), "none": (1.0, None, True)}
    assert boxes.annotated(images.limit(0), detect).count() == 0


def test_pages_are_handed_on_in_lots():
    import pandas as pd

    from tessera.operators import pages

    lots = []

    class Pages:
        """A frame's names, and the function run at once on one batch."""

        sparkSession = type("Session", (), {"createDataFrame": staticmethod(lambda rows, kinds: type("Frame", (), {"columns": [x.split()[0] for x in pages.SCHEMA.replace("map<string,string>", "map").split(", ")[:11]], "schema": []}))})  # noqa: N815 - Spark's name
        select = lambda self, *_: self

        @staticmethod
        def mapInPandas(run, kinds):  # noqa: N802 - Spark's name
            html = ["<title>t</title>", None, "<p>" + "x" * pages.CHARS] + ["<title>u</title>"] * 1000
            lots.extend(run(iter([pd.DataFrame({"page_id": range(len(html)), "html": html})])))

    before, pages.F = pages.F, type("F", (), {"col": staticmethod(lambda c: type("C", (), {"cast": lambda s, k: s, "alias": lambda s, n: s})())})
    try:
        pages.read_pages(Pages())
    finally:
        pages.F = before
    assert len(lots[0]) == 3 and max(map(len, lots)) <= pages.PAGES
    assert [i for x in lots for i in x["page_id"]] == list(range(1003)) and lots[0]["title"].tolist() == ["t", "Unknown Title", "Unknown Title"]


def test_annotator_calls_few_times():
    import pandas as pd

    calls = []

    def detect(batch):
        calls.append(len(batch))
        if (batch["image"] == 777).any():
            raise KeyError("broken")
        rows = pd.DataFrame({"image": batch["image"], "cx": 0.1, "cy": 0.2, "w": 0.3, "h": 0.4, "score": 0.9, "error": None})
        rows.loc[rows["image"] % 3 == 0, "error"] = "unreadable"
        return rows

    class Images:
        """A frame's schema, and the function run at once on one batch."""

        schema = {"image": type("Field", (), {"dataType": type("Kind", (), {"simpleString": staticmethod(lambda: "long")})})}

        @staticmethod
        def mapInPandas(run, kinds):  # noqa: N802 - Spark's name
            return pd.concat(run(iter([pd.DataFrame({"image": range(4000)})])))

    got = boxes.annotated(Images, detect)
    assert len(calls) < 30 and len(got) == 4000 and got["image"].nunique() == 4000
    why = got.set_index("image")["error"]
    assert why[777] == "KeyError: 'broken'" and why[3] == "unreadable" and why[1] is None
    assert set(got.loc[got["fallback"], "image"]) == {i for i in range(4000) if i % 3 == 0}  # 777 is one of them


def test_null_order_values(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 3, 2), ("b", None, 7)], "k string, seq int, v int")
    assert {(r.k, r.v) for r in tables.keep_last(df, "k", "seq").collect()} == {(r.k, r.v) for r in tables.keep_first(df, "k", "seq").collect()} == {("a", 2), ("b", 7)}


def test_weights(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 10), ("c", 1000)], "c string, n int")
    w = [r.weight for r in features.class_weights(counts).orderBy("c").collect()]
    assert abs(sum(w) - 3) < 1e-9 and w[0] > w[1] > w[2]
    df = spark.createDataFrame([(i, "a" if i < 90 else "b") for i in range(100)], "k int, c string")
    assert abs(features.sampling_weights(df, "c").agg(F.sum("draw_chance")).first()[0] - 1) < 1e-9
    got = {r.c: r["count"] for r in features.balanced_sample(df, "c", "k", 2000).groupBy("c").count().collect()}
    assert sum(got.values()) == 2000 and all(850 < n < 1150 for n in got.values())


def test_suppression(spark):
    rng = random.Random(1)
    rows = [(f"i{k % 20}", k, rng.random(), rng.random(), rng.uniform(0.2, 0.9), rng.uniform(0.2, 0.9), rng.random()) for k in range(200)]
    df = spark.createDataFrame(rows, "image string, box_id long, cx double, cy double, w double, h double, score double").cache()
    kept = boxes.nms(df)
    assert boxes.iou_pairs(kept).count() == 0 and 20 < kept.count() < 200
    best = boxes.nms(df, mode="best")
    assert best.count() == 20 and best.join(kept, "box_id", "left_anti").count() == 0 and boxes.nms(df, mode="all").count() == 200
    near = df.alias("a").join(kept.alias("b"), "image").select(F.col("a.box_id").alias("k"), iou(*({c: F.col(f"{t}.{c}") for c in ("cx", "cy", "w", "h")} for t in "ab")).alias("i"))
    assert near.groupBy("k").agg(F.max("i").alias("m")).filter("m <= 0.5").join(kept.withColumnRenamed("box_id", "k"), "k", "left_anti").count() == 0


@SETTINGS
@given(st.lists(st.integers(1, 120), min_size=1, max_size=40))
def test_batches_fit(spark, sizes):
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate(sizes)], "g string, i int, s long")
    got = sorted(tuple(r) for r in workplan.batch_by_bytes(df, "g", "i", "s", 100, 10).select("i", "s", "batch").collect())
    want, batch, used, n = [], 0, 10, 0
    for i, s in enumerate(sizes):
        if used + s > 100 and n:
            batch, used, n = batch + 1, 10, 0
        used, n = used + s, n + 1
        want.append((i, s, batch))
    assert got == want


def test_breaker_lease_mean_and_best(spark):
    oks = [False] * 10 + [True] + [False] * 9 + [True] + [False] * 20 + [False]
    log = spark.createDataFrame([("k", i, ok) for i, ok in enumerate(oks)], "key string, i int, ok boolean")
    got = workplan.circuit_breaker(log, "key", "i", "ok").orderBy("i").collect()
    assert [r.i for r in got if r.trip] == [9, 30, 40] and len(got) == 41
    lease = spark.createDataFrame([("k", s) for s in (0, 300, 599, 600, 1199, 1200)], "key string, s long")
    assert sorted(r.granted for r in workplan.lease_grants(lease, "key", "s").collect()) == [0, 600, 1200]
    run = spark.createDataFrame([("r", i, v) for i, v in enumerate([1.0, 2.0, 3.0])], "run string, i int, v double")
    assert abs(workplan.ema(run, "run", "i", "v").first().ema - 1.29) < 1e-12
    best = spark.createDataFrame([(i, v) for i, v in enumerate([0.2, 0.1, 0.3, 0.3])], "epoch int, f double")
    assert sorted(r.epoch for r in workplan.best_so_far(best, "epoch", "f").collect()) == [0, 2]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k int, c string, n long")
    assert audit.missing_fields(none, ["c"]).first() == ("c", 0, 0, 0.0)
    assert splits.stratified_split(none, "k", "c").count() == tables.numbered(none, ["k"]).count() == audit.threshold_table(none).count() == 0
    assert tables.next_id(spark.createDataFrame([("x",), ("7",)], "k string"), "k").first()[0] == 8


def test_page_parts():
    got = pages.read_page("""<title> A  b </title><ul id="system-breadcrumb-listing"><li><a><span class="style-Genus">G</span><span>common</span></a><li><a><span class="style-Genus">H</span></a></ul>
      <div id="early"><p>one<p>,<p>two</div><div id=stat><p>text<div><p>inner</div><table><tr><th>A<th>B<tr><td>1<td>x<td>y<tr><td>2</table></div>
      <div class="textContent"><h4>Other</h4><a class=spe-a href=/q>no</a></div><div class="textContent"><h4>Nectar Plant of</h4><a class="spe-a" href="/p-q/">Genus sp – Name</a></div>
      <a class="colorbox" href="/i.jpg" data-cbox-img-attrs='{"alt": "cap"}'></a><a class="colorbox" href="/i.jpg"></a><a class=colorbox href=http://z/j.jpg data-cbox-img-attrs="{bad"></a>""")
    assert got["title"] == "A b" and got["taxonomy"] == {"Genus": "G"} and got["common_names"] == {"Genus": "common"} and got["early_text"] == ["one", "two"]
    assert got["sightings"] == [{"A": "1", "B": "x"}, {"A": "2"}] and got["description"] == ["text"]
    assert got["hosts"] == [{"scientific": "Genus sp", "common": "Name", "slug": "p-q", "url": "https://site.example/p-q/"}]
    assert [(i["url"], i["caption"]) for i in got["images"]] == [("https://site.example/i.jpg", "cap"), ("http://z/j.jpg", "Unknown")]
    assert len(pages.read_page("<div class=textContent><h4>Other</h4><a class=spe-a href=/q>x</a></div>", any_heading=True)["hosts"]) == 1
    assert pages.read_page(None)["title"] == "Unknown Title" and pages.read_page("")["sightings"] == []
