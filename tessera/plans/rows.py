"""Registered queries: filters, look-ups, choice of rows, numbering, splits, sets, work planning, boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.numbers import crop_rows, is_recent
from tessera.functions.text import extension
from tessera.operators import boxes, features, graph, splits, tables, workplan
from tessera.plans.base import on, table
from tessera.plans.reports import split_sql
from tessera.schema import renamed

HOST = r"^[a-z]+://([^/]+)"
SECONDS = "epoch(ts)"


def docs_keyed(d):
    """Rows keyed by their text, in order of doc_id."""
    return d.select(F.md5("text").alias("k"), F.col("doc_id").alias("seq"), "lang", "source")


def page_hosts(p):
    return p.select("page_id", F.regexp_extract("url", HOST, 1).alias("host"))


def existing_splits(d):
    return splits.stratified_split(d.filter("doc_id % 10 < 6"), "doc_id", "lang")


def failures(e):
    return e.select("user_id", F.struct("ts", "event_id").alias("o"), "event_id", (F.col("event_type") != "error").alias("ok"))


def line_boxes(spark, sf):
    """A box for each line item: image = order, score by price, place by rules of its keys."""
    li = table(spark, sf, "lineitem")
    n = lambda c, m, a: ((F.col(c) % m) + a) / F.lit(100.0)
    return li.select(
        F.col("l_orderkey").alias("image"), (F.col("l_linenumber") * F.lit(10**12) + F.col("l_partkey") * F.lit(10**6) + F.col("l_suppkey")).alias("box_id"), (F.col("l_suppkey") % 7).cast("int").alias("class_id"),
        n("l_partkey", 20, 40).alias("cx"), n("l_suppkey", 20, 40).alias("cy"), n("l_partkey", 60, 35).alias("w"), n("l_suppkey", 50, 50).alias("h"), F.col("l_extendedprice").alias("score"),
    )


BOX_SQL = """(SELECT l_orderkey AS image, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS box_id, l_suppkey % 7 AS class_id, (l_partkey % 20 + 40) / 100.0::DOUBLE AS cx, (l_suppkey % 20 + 40) / 100.0::DOUBLE AS cy,
 (l_partkey % 60 + 35) / 100.0::DOUBLE AS w, (l_suppkey % 50 + 50) / 100.0::DOUBLE AS h, l_extendedprice AS score FROM lineitem)"""
IOU_SQL = """greatest(least(a.cx + a.w / 2, b.cx + b.w / 2) - greatest(a.cx - a.w / 2, b.cx - b.w / 2), 0) * greatest(least(a.cy + a.h / 2, b.cy + b.h / 2) - greatest(a.cy - a.h / 2, b.cy - b.h / 2), 0)"""
PAIR_SQL = f"""SELECT a.image, a.box_id AS keep, b.box_id AS "drop", i / (a.w * a.h + b.w * b.h - i) AS iou FROM (SELECT a, b, {IOU_SQL} AS i FROM {BOX_SQL} a JOIN {BOX_SQL} b
 ON a.image = b.image AND (a.score > b.score OR a.score = b.score AND a.box_id < b.box_id)) WHERE i / (a.w * a.h + b.w * b.h - i) > 0.5"""


def image_sizes(o):
    return o.select(F.col("o_orderkey").alias("image"), (F.lit(600) + F.col("o_custkey") % 21 * 20).cast("int").alias("width"), (F.lit(500) + F.col("o_custkey") % 16 * 20).cast("int").alias("height"))


def coco_rows(spark, sf):
    sizes = image_sizes(table(spark, sf, "orders").filter("o_orderkey % 9 <> 0"))
    a = boxes.annotations(line_boxes(spark, sf), sizes)
    return a.select("image", "box_id", "class_id", "width", "height", "bbox.x", "bbox.y", F.col("bbox.w").alias("bw"), F.col("bbox.h").alias("bh"), F.round("area", 3).alias("area"))


def nested(spark, sf):
    """Images with their annotations nested; ids, slugs and counts of each."""
    o = table(spark, sf, "orders")
    cats = spark.createDataFrame([(i, f"class-{i}") for i in range(7)], "class_id int, slug string")
    out = boxes.coco(image_sizes(o).select("image"), boxes.annotations(line_boxes(spark, sf), image_sizes(o)), cats)
    return out.select("image", F.coalesce(F.array_size("annotations"), F.lit(0)).alias("n"), F.array_join(F.transform("annotations", lambda x: x["slug"]), ",").alias("slugs"))


def append_orders(o, li):
    done = o.join(li.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    new = tables.pending(o, li.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey").select("o_orderkey")
    return tables.append_ids(new, ["o_orderkey"], done.select(F.col("o_custkey").alias("image_id")), "image_id")


def url_lists(p):
    one = p.select("url", F.col("page_id").alias("pos"))
    two = p.filter("page_id % 3 = 0").select(F.regexp_replace("url", "^http:", "https:").alias("url"), (-F.col("page_id")).alias("pos"))
    return one, two


def candidate_lookup(o, c):
    rows = o.select("o_orderkey", "o_custkey")
    dim = c.filter("c_custkey % 2 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("k"), "c_name")
    name = lambda x: F.concat(F.lit("c"), x.cast("string"))
    return tables.lookup_ordered(rows, [name(F.col("o_custkey")), name(F.col("o_custkey") + 1), name(F.col("o_custkey") + 3)], dim, "k", "o_orderkey")


def registry_entries(e):
    x = e.select("user_id", "event_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return x.withColumns({"types": F.array("event_type"), "days": F.array("day")})


def registry(e):
    return registry_row(tables.upsert_registry(registry_entries(e), "user_id", "event_id", ["event_type", "day"], ["types", "days"]))


def registry_row(out):
    return out.select("user_id", "event_type", "day", F.array_join("types", ",").alias("types"), F.size("days").alias("n_days"), F.array_join(F.slice("days", 1, 3), ",").alias("first_days"))


def inventory(p):
    """Files of every second page under images, every third by class folder."""
    name = F.concat(F.col("page_id").cast("string"), F.lit(".jpg"))
    return p.filter("page_id % 2 = 0").select(F.concat(F.lit("images/"), name).alias("path")).union(p.filter("page_id % 3 = 0").select(F.concat(F.lit("images/c_"), (F.col("page_id") % 5).cast("string"), F.lit("/"), name)))


def resolved(p):
    name = F.concat(F.col("page_id").cast("string"), F.lit(".jpg"))
    given = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("butterflies/raw/"), name)).when(F.col("page_id") % 4 == 1, F.concat(F.lit("x/images/"), name)).otherwise(name)
    rows = p.select("page_id", given.alias("given"), F.concat(F.lit("c "), (F.col("page_id") % 5).cast("string")).alias("cls"))
    return tables.resolve_paths(rows, tables.path_candidates(F.col("given"), F.col("cls")), inventory(p), "page_id")


def sizes_differ(o):
    """Keys to fetch: not there or of another size."""
    remote = o.select("o_orderkey", F.col("o_custkey").alias("size"))
    local = o.filter("o_orderkey % 3 <> 0").select("o_orderkey", (F.col("o_custkey") + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)).alias("size"))
    return tables.to_fetch(remote, local, "o_orderkey", "size")


def tumbling(e, minutes=60):
    return e.groupBy(F.window("ts", f"{minutes} minutes").alias("_w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_timestamp("_w.start").alias("start"), "event_type", "n")


def sessions(e):
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("_w")).agg(F.count("*").alias("n")).select("user_id", F.unix_micros(F.col("_w.start").cast("timestamp")).alias("start_us"), "n")


QUERIES = {
    "resolve_and_filter": (
        on("part")(lambda p: tables.require(tables.drop_early(tables.keep_category(renamed(p, {"category": ["kind", "p_type"], "file": ["image", "p_name"]}), ["category"], "E"), "file", "category", "a b|zz", "small"), "p_brand").select("p_partkey")),
        "SELECT p_partkey FROM part WHERE contains(lower(p_type), 'e') AND NOT (regexp_matches(p_name, 'a b|zz') OR contains(lower(p_type), 'small')) AND trim(p_brand) <> ''",
    ),
    "refined_overwrite": (
        on("part")(lambda p: tables.overwrite_from(p.select("p_partkey", F.col("p_brand").alias("location"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise(" ").alias("refined")), "location", "refined", F.lower)),
        "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) ELSE p_brand END AS location FROM part",
    ),
    "cardinality_sample": (
        on("lineitem")(lambda d: tables.by_cardinality(d, "l_orderkey")),
        """WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT * FROM (SELECT * FROM c WHERE n > 1 ORDER BY l_orderkey LIMIT 3)
 UNION ALL SELECT * FROM (SELECT * FROM c WHERE n = 1 ORDER BY l_orderkey LIMIT 2)""",
    ),
    "required_artifacts": (
        on("documents", "labels")(lambda d, l: tables.required_present(d, d.join(l.filter("toxic = 1 and quality = 0"), "doc_id", "left_semi"), "source")),
        """SELECT source, CASE WHEN bool_or(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND quality = 0)) THEN 'PASS' ELSE 'FAIL' END AS status FROM documents GROUP BY 1""",
    ),
    "two_way_difference": (
        on("documents", "labels")(lambda d, l: tables.two_way_difference(d, l.withColumn("doc_id", F.col("doc_id") + F.when(F.col("doc_id") % 5 == 0, 1000000).otherwise(0)), "doc_id")),
        """WITH b AS (SELECT doc_id + CASE WHEN doc_id % 5 = 0 THEN 1000000 ELSE 0 END AS doc_id FROM labels) SELECT DISTINCT doc_id, 'left' AS only_in FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM b)
 UNION ALL SELECT DISTINCT doc_id, 'right' FROM b WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
    ),
    "dedupe_keep_last": (
        on("documents")(lambda d: tables.keep_last(docs_keyed(d), "k", "seq")),
        "SELECT md5(text) AS k, max(doc_id) AS seq, arg_max(lang, doc_id) AS lang, arg_max(source, doc_id) AS source FROM documents GROUP BY 1",
    ),
    "renumber": (
        on("documents")(lambda d: tables.numbered(tables.keep_last(docs_keyed(d), "k", "seq").select("seq"), ["seq"])),
        "SELECT seq, row_number() OVER (ORDER BY seq) AS image_id FROM (SELECT max(doc_id) AS seq FROM documents GROUP BY md5(text))",
    ),
    "keep_first_order": (
        on("pages")(lambda p: tables.keep_first(page_hosts(p), "host", "page_id")),
        "SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, min(page_id) AS page_id FROM pages GROUP BY 1",
    ),
    "last_write_wins": (
        on("events")(lambda e: tables.last_write(e.withColumn("p", (F.col("event_type") == "error").cast("int")), "user_id", "event_type", "p", "event_id")),
        "SELECT user_id, arg_max(event_type, CAST(event_type = 'error' AS INT) * 1000000000000 + event_id) AS event_type FROM events GROUP BY 1",
    ),
    "merge_ordered_lists": (
        on("pages")(lambda p: tables.merge_ordered(url_lists(p), "url", "pos")),
        """SELECT url, min(rank) AS rank, arg_min(pos, rank * 1000000000 + pos) AS pos FROM (SELECT url, 0 AS rank, page_id AS pos FROM pages
 UNION ALL SELECT regexp_replace(url, '^http:', 'https:'), 1, -page_id FROM pages WHERE page_id % 3 = 0) GROUP BY 1""",
    ),
    "merge_logs": (
        on("pages")(lambda p: tables.merge_logs(*url_lists(p), "url")),
        "SELECT url FROM pages UNION SELECT regexp_replace(url, '^http:', 'https:') FROM pages WHERE page_id % 3 = 0",
    ),
    "stratified_split": (on("documents")(lambda d: splits.stratified_split(d, "doc_id", "lang")), split_sql()),
    "stratified_split_80_10_10": (on("documents")(lambda d: splits.stratified_split(d, "doc_id", "source", train=0.8, val=0.1)), split_sql("source", train="0.8", val="0.1")),
    "stable_split_append": (
        on("documents")(lambda d: splits.stable_split(d, existing_splits(d), "doc_id", "lang")),
        f"{split_sql(rows='(SELECT * FROM documents WHERE doc_id % 10 < 6)')} UNION ALL {split_sql(rows='(SELECT * FROM documents WHERE doc_id % 10 >= 6)')}",
    ),
    "split_default_lookup": (
        on("documents")(lambda d: tables.lookup_default(d.select("doc_id"), existing_splits(d).filter("split <> 'test'"), "doc_id", "split", "train")),
        f"SELECT d.doc_id, coalesce(s.split, 'train') AS split FROM documents d LEFT JOIN (SELECT * FROM ({split_sql(rows='(SELECT * FROM documents WHERE doc_id % 10 < 6)')}) WHERE split <> 'test') s ON s.doc_id = d.doc_id",
    ),
    "enrich_candidate_keys": (
        on("orders", "customer")(candidate_lookup),
        """SELECT o_orderkey, o_custkey, k, c_name FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 2 = 0 AND o_custkey IN (SELECT c_custkey FROM customer) THEN o_custkey
 WHEN (o_custkey + 1) % 2 = 0 AND o_custkey + 1 IN (SELECT c_custkey FROM customer) THEN o_custkey + 1 WHEN (o_custkey + 3) % 2 = 0 AND o_custkey + 3 IN (SELECT c_custkey FROM customer) THEN o_custkey + 3 END AS hit FROM orders)
 LEFT JOIN (SELECT 'c' || c_custkey AS k, c_custkey, c_name FROM customer) ON c_custkey = hit""",
    ),
    "common_name_overwrite": (
        on("customer", "nation")(lambda c, n: tables.lookup_overwrite(c.select("c_custkey", F.col("c_mktsegment").alias("name"), F.col("c_nationkey").alias("k")), F.broadcast(n.filter("n_regionkey < 3").select(F.col("n_nationkey").alias("k"), "n_name")), "k", "name", "n_name")),
        "SELECT c_custkey, coalesce(n_name, c_mktsegment) AS name, c_nationkey AS k FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON n_nationkey = c_nationkey",
    ),
    "registry_upsert": (
        on("events")(registry),
        """WITH e AS (SELECT user_id, event_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events), t AS (SELECT user_id, event_type, min(event_id) AS f FROM e GROUP BY 1, 2),
 d AS (SELECT user_id, day, min(event_id) AS f, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) AS r FROM e GROUP BY 1, 2)
 SELECT user_id, arg_min(event_type, event_id) AS event_type, arg_min(day, event_id) AS day, (SELECT string_agg(event_type, ',' ORDER BY f) FROM t WHERE t.user_id = e.user_id) AS types,
 count(DISTINCT day) AS n_days, (SELECT string_agg(day, ',' ORDER BY f) FROM d WHERE d.user_id = e.user_id AND r <= 3) AS first_days FROM e GROUP BY user_id""",
    ),
    "resolve_paths": (
        on("pages")(resolved),
        """WITH inv AS (SELECT 'images/' || page_id || '.jpg' AS path FROM pages WHERE page_id % 2 = 0 UNION SELECT 'images/c_' || (page_id % 5) || '/' || page_id || '.jpg' FROM pages WHERE page_id % 3 = 0)
 SELECT page_id, coalesce((SELECT path FROM inv WHERE path = 'images/' || page_id || '.jpg'), (SELECT path FROM inv WHERE path = 'images/c_' || (page_id % 5) || '/' || page_id || '.jpg')) AS resolved FROM pages""",
    ),
    "append_ids": (
        on("orders", "lineitem")(append_orders),
        """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) + (SELECT coalesce(max(o_custkey), 0) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS image_id
 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
    ),
    "incremental_pending": (
        on("orders", "lineitem")(lambda o, l: tables.pending(o.select("o_orderkey", "o_orderstatus"), l.filter("l_linenumber > 2").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")),
        "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 2)",
    ),
    "run_counters": (
        on("events", "documents", "labels")(lambda e, d, l: workplan.run_counters(e.select((F.col("event_type") != "error").alias("ok")), d, l, "doc_id")),
        """SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS planned, (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS done,
 count(*) FILTER (event_type <> 'error') AS success, count(*) FILTER (event_type = 'error') AS failed,
 (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS remaining FROM events""",
    ),
    "same_size_skip": (
        on("orders")(sizes_differ),
        """SELECT o_orderkey, o_custkey AS size, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey + 1 END AS local_size FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0""",
    ),
    **{
        f"chunk_{name}": (
            on("pages")(lambda p, mode=mode: workplan.chunks(p.select("page_id"), ["page_id"], 7, mode)),
            f"SELECT page_id, CAST({sql} AS BIGINT) AS chunk FROM (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS i, count(*) OVER () AS n FROM pages)",
        )
        for name, mode, sql in (("contiguous", "contiguous", "floor(i / ceil(n / 7))"), ("floor_plus_one", "plus_one", "floor(i / (floor(n / 7) + 1))"), ("round_robin", "round_robin", "i % 7"))
    },
    "batch_by_count": (
        on("documents")(lambda d: workplan.batch_by_count(d.select("doc_id"), ["doc_id"], 20)),
        "SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 20) AS BIGINT) AS batch FROM documents",
    ),
    "batch_by_bytes": (
        on("documents")(lambda d: workplan.batch_by_bytes(d, "source", "doc_id", "n_chars", 20000, 50)),
        """WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
 f AS (SELECT source, doc_id, n_chars, r, CAST(0 AS BIGINT) AS batch, CAST(50 + n_chars AS BIGINT) AS used FROM d WHERE r = 1
 UNION ALL SELECT d.source, d.doc_id, d.n_chars, d.r, CASE WHEN f.used + d.n_chars > 20000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.used + d.n_chars > 20000 THEN 50 + d.n_chars ELSE f.used + d.n_chars END
 FROM f JOIN d ON d.source = f.source AND d.r = f.r + 1) SELECT source, doc_id, n_chars, batch FROM f""",
    ),
    "circuit_breaker": (
        on("events")(lambda e: workplan.circuit_breaker(failures(e), "user_id", "o", "ok", 2, 3).select("user_id", "event_id", "trip")),
        """WITH a AS (SELECT user_id, ts, event_id, CAST(event_type <> 'error' AS INT) AS ok FROM events), b AS (SELECT *, sum(ok) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS isl FROM a),
 c AS (SELECT *, sum(1 - ok) OVER (PARTITION BY user_id, isl ORDER BY ts, event_id) AS rn FROM b), d AS (SELECT *, ok = 0 AND rn % 2 = 0 AS trip FROM c),
 e AS (SELECT *, coalesce(sum(CAST(trip AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM d) SELECT user_id, event_id, trip FROM e WHERE b < 3""",
    ),
    "lease_grants": (
        on("events")(lambda e: workplan.lease_grants(e.select("user_id", F.unix_timestamp("ts").alias("s")), "user_id", "s", 36000)),
        """WITH RECURSIVE t AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events), g AS (SELECT user_id, min(s) AS granted FROM t GROUP BY 1
 UNION ALL SELECT g.user_id, (SELECT min(s) FROM t WHERE t.user_id = g.user_id AND s >= g.granted + 36000) FROM g WHERE (SELECT min(s) FROM t WHERE t.user_id = g.user_id AND s >= g.granted + 36000) IS NOT NULL)
 SELECT user_id, granted FROM g""",
    ),
    "ema_metric": (
        on("events")(lambda e: workplan.ema(e, "user_id", "event_id", "value").withColumn("ema", F.round("ema", 6))),
        """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
 SELECT user_id, max(n) AS n, round(sum(value * pow(0.9::DOUBLE, n - i) * CASE WHEN i = 1 THEN 1 ELSE 0.1::DOUBLE END), 6) AS ema FROM r GROUP BY 1""",
    ),
    "best_checkpoint": (
        on("events")(lambda e: workplan.best_so_far(e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.max("value").alias("v")), "day", "v", "event_type")),
        """WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, max(value) AS v FROM events GROUP BY 1, 2)
 SELECT day, event_type, v FROM (SELECT *, coalesce(max(v) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM d) WHERE v > m""",
    ),
    "host_graph_degrees": (
        on("lineitem")(lambda d: graph.degrees(d.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))),
        """SELECT 'src' AS side, CAST(l_partkey AS VARCHAR) AS node, count(DISTINCT l_suppkey) AS degree FROM lineitem GROUP BY 2
 UNION ALL SELECT 'dst', CAST(l_suppkey AS VARCHAR), count(DISTINCT l_partkey) FROM lineitem GROUP BY 2""",
    ),
    "label_union": (
        on("documents", "part")(lambda d, p: features.class_index([d.select(F.col("lang").alias("c")), p.select(F.substring("p_type", 1, 3).alias("c"))], "c").select("c")),
        "SELECT lang AS c FROM documents UNION SELECT substring(p_type, 1, 3) FROM part",
    ),
    "coco_annotations": (
        coco_rows,
        f"""WITH s AS (SELECT o_orderkey AS image, 600 + o_custkey % 21 * 20 AS width, 500 + o_custkey % 16 * 20 AS height FROM orders WHERE o_orderkey % 9 <> 0),
 b AS (SELECT b.*, coalesce(width, 700) AS width, coalesce(height, 600) AS height FROM {BOX_SQL} b LEFT JOIN s USING (image))
 SELECT image, box_id, class_id, width, height, round_even((cx - w / 2) * width, 1) AS x, round_even((cy - h / 2) * height, 1) AS y, round_even(w * width, 1) AS bw, round_even(h * height, 1) AS bh,
 round(w * width * h * height, 3) AS area FROM b""",
    ),
    "coco_nested": (
        nested,
        f"""SELECT o_orderkey AS image, count(box_id) AS n, string_agg('class-' || class_id, ',' ORDER BY box_id) AS slugs FROM orders LEFT JOIN {BOX_SQL} b ON b.image = o_orderkey GROUP BY 1""",
    ),
    "full_image_fallback": (
        lambda spark, sf: boxes.with_fallback(image_sizes(table(spark, sf, "orders")), boxes.reject_large(line_boxes(spark, sf), 0.2)).drop("score"),
        f"""SELECT o_orderkey AS image, coalesce(cx, 0.5) AS cx, coalesce(cy, 0.5) AS cy, coalesce(w, 1) AS w, coalesce(h, 1) AS h FROM orders LEFT JOIN (SELECT * FROM {BOX_SQL} WHERE w * h <= 0.2) ON image = o_orderkey""",
    ),
    "yolo_lines": (
        lambda spark, sf: boxes.yolo_lines(line_boxes(spark, sf)),
        f"SELECT image, printf('%d %.6f %.6f %.6f %.6f', class_id, cx, cy, w, h) AS line FROM {BOX_SQL}",
    ),
    "reject_full_image": (lambda spark, sf: boxes.reject_large(line_boxes(spark, sf)).select("image", "box_id"), f"SELECT image, box_id FROM {BOX_SQL} WHERE w * h <= 0.9"),
    "crop_boxes": (
        on("orders")(lambda o: image_sizes(o).select("image", crop_rows(F.col("height")).alias("c")).select("image", F.col("c.top").alias("top"), F.col("c.bottom").alias("bottom"), F.col("c.ok").alias("ok"))),
        """SELECT o_orderkey AS image, CAST(floor((500 + o_custkey % 16 * 20) * 0.12::DOUBLE) AS INT) AS top, CAST(floor((500 + o_custkey % 16 * 20) * 0.9::DOUBLE) AS INT) AS bottom,
 floor((500 + o_custkey % 16 * 20) * 0.9::DOUBLE) > floor((500 + o_custkey % 16 * 20) * 0.12::DOUBLE) AS ok FROM orders""",
    ),
    "iou_pairs": (lambda spark, sf: boxes.iou_pairs(line_boxes(spark, sf)).withColumn("iou", F.round("iou", 6)), f'SELECT image, keep, "drop", round(iou, 6) AS iou FROM ({PAIR_SQL})'),
    "best_box": (
        lambda spark, sf: boxes.best_box(line_boxes(spark, sf)).select("image", "box_id", "score"),
        f"SELECT image, box_id, score FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, box_id) AS r FROM {BOX_SQL}) WHERE r = 1",
    ),
    "nms_boxes": (
        lambda spark, sf: boxes.nms(line_boxes(spark, sf)).select("image", "box_id"),
        f"""WITH RECURSIVE r AS (SELECT image, box_id, row_number() OVER (PARTITION BY image ORDER BY score DESC, box_id) AS k FROM {BOX_SQL}), p AS ({PAIR_SQL}),
 f AS (SELECT image, k, [box_id] AS kept FROM r WHERE k = 1
 UNION ALL SELECT r.image, r.k, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.image = r.image AND p."drop" = r.box_id AND list_contains(f.kept, p.keep)) THEN f.kept ELSE list_append(f.kept, r.box_id) END FROM f JOIN r ON r.image = f.image AND r.k = f.k + 1)
 SELECT image, unnest(kept) AS box_id FROM (SELECT image, arg_max(kept, k) AS kept FROM f GROUP BY 1)""",
    ),
    "tumbling_counts": (
        on("events")(tumbling),
        "SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    ),
    "session_counts": (
        on("events")(sessions),
        """WITH a AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events),
 b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM b GROUP BY user_id, s""",
    ),
    "keyword_sample": (
        on("part")(lambda p: tables.keyword_sample(p.select("p_partkey", "p_name"), "p_name", "A", ["p_name", "p_partkey"], 20)),
        "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') ORDER BY p_name, p_partkey LIMIT 20",
    ),
    "existing_sample": (
        on("orders", "lineitem")(lambda o, l: tables.first_existing(o.select("o_orderkey"), l.filter("l_linenumber = 2").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", 25)),
        "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2) ORDER BY 1 LIMIT 25",
    ),
    "field_present": (
        on("documents", "labels")(lambda d, l: tables.present_count(d.join(l, "doc_id", "left"), "toxic")),
        "SELECT count(toxic) AS present, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    ),
    "direct_children": (
        on("pages")(lambda p: tables.children(p.select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"), "page_id"), "path", "blog.").select("page_id", "depth", "name")),
        """SELECT page_id, len(string_split(p, '/')) AS depth, split_part(p, '/', 1) AS name FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS p FROM pages) WHERE starts_with(p, 'blog.')""",
    ),
    "recent_claims": (
        on("events")(lambda e: e.filter(is_recent(F.col("ts").cast("timestamp"), F.lit("2024-01-15 12:00:00").cast("timestamp"), 86400) & (F.col("ts") <= F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))).select("event_id")),
        "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-14 12:00:00' AND ts <= TIMESTAMP '2024-01-15 12:00:00'",
    ),
    "file_extensions": (
        on("pages")(lambda p: p.select(extension(F.col("url")).alias("ext")).groupBy("ext").agg(F.count("*").alias("n"))),
        r"SELECT lower(regexp_extract(split_part(url, '/', -1), '(\.[^.]+)$', 1)) AS ext, count(*) AS n FROM pages GROUP BY 1",
    ),
}
