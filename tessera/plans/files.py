"""Registered queries that write files or streams and read them back, and the small text functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X
from tessera.operators import features, sketches, splits
from tessera.operators.registry import Registry
from tessera.plans import rows
from tessera.plans.base import table
from tessera.plans.reports import split_sql
from tessera.shared import shared_dir
from tessera.sources import named_files, readers, writers
from tessera.streaming import incremental, ordered


def metadata(spark, sf):
    """Documents and parts as the two metadata tables; what one table lacks is null."""
    path, d, p = shared_dir(spark, "metadata"), table(spark, sf, "documents"), table(spark, sf, "part")
    writers.csv_table(d.select(F.col("doc_id").alias("image_id"), F.col("source").alias("species"), F.col("text").alias("location"), F.col("lang").alias("sex")), f"{path}/butterflies/metadata.csv")
    writers.csv_table(p.select(F.col("p_partkey").alias("image_id"), F.col("p_name").alias("species"), F.col("p_type").alias("butterfly_hosts")), f"{path}/plants/metadata.csv")
    kinds = {"butterflies": "image_id long, species string, location string, sex string", "plants": "image_id long, species string, butterfly_hosts string"}
    out = readers.metadata(spark, path, {name: T.StructType.fromDDL(ddl) for name, ddl in kinds.items()})
    return out.select("dataset", "image_id", "species", F.md5("location").alias("location"), "sex", "butterfly_hosts")


def json_lines(spark, sf):
    """Two records of each document, a blank line and a broken one between them; the last record stays."""
    path, d = shared_dir(spark, "records"), table(spark, sf, "documents")
    record = lambda title: F.to_json(F.struct(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file_name"), title.alias("page_title"), F.create_map(F.lit("Family"), F.col("lang")).alias("taxonomy")))
    d.select(F.concat_ws("\n", record(F.lit("old")), F.lit(""), F.lit("{broken"), record(F.col("source"))).alias("value")).write.text(path)
    rows = readers.json_records(spark, path, T.StructType.fromDDL("file_name string, page_title string, taxonomy map<string,string>"), "file_name")
    return rows.select("file_name", "page_title", F.try_element_at("taxonomy", F.lit("Family")).alias("family"))


def json_appended(spark, sf):
    path, d = shared_dir(spark, "appended"), table(spark, sf, "documents").select("doc_id", "text")
    writers.json_records(d.filter("doc_id % 2 = 0"), path)
    writers.json_records(d.filter("doc_id % 2 <> 0"), path, append=True)
    return readers.json_records(spark, path, d.schema).select("doc_id", F.md5("text").alias("text"))


def split_files(spark, sf):
    path = shared_dir(spark, "lists")
    made = splits.stratified_split(table(spark, sf, "documents"), "doc_id", "lang").select("split", F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("filename"))
    writers.split_lists(made, path)
    out = None
    for s in ("train", "val", "test"):
        part = readers.line_list(spark, f"{path}/split={s}", "filename").withColumn("split", F.lit(s))
        out = part if out is None else out.unionByName(part)
    return out


def box_lines(spark, sf):
    path, li = shared_dir(spark, "boxes"), table(spark, sf, "lineitem")
    line = F.format_string("%d %.6f 0.500000 0.250000 0.125000", F.col("l_linenumber"), F.col("l_quantity").cast("double") / 100)
    writers.box_files(li.select(F.lit("d").alias("dataset"), F.col("l_returnflag").alias("slug"), F.col("l_orderkey").cast("string").alias("image"), line.alias("line")), path)
    got = spark.read.text(path).select(F.split("value", "\t").alias("p"), "slug")
    return got.select("slug", F.col("p")[0].alias("image"), F.col("p")[1].alias("line"))


def _part_boxes(spark, sf):
    """Each part as an image with a box for each of its line items."""
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    own = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    boxes = {"cx": F.lit(0.5), "cy": F.col("l_quantity").cast("double") / 100, "w": F.col("l_discount").cast("double"), "h": F.col("l_tax").cast("double")}
    return own.select(F.lit("parts").alias("dataset"), F.col("p_brand").alias("slug"), F.col("l_partkey").cast("string").alias("image"), F.col("l_linenumber").alias("class_id"), *(c.alias(n) for n, c in boxes.items()))


def image_box_files(spark, sf):
    """A file for each image, written twice, read back with the number of files of its folder."""
    path, boxes = shared_dir(spark, "image-boxes"), _part_boxes(spark, sf)
    for _ in range(2):  # the second time replaces every file
        writers.image_boxes(boxes, path)
    counts = readers.image_names(named_files.list_named(spark, path)).groupBy(F.col("slug").alias("_slug")).agg(F.count("*").alias("files"))
    boxes = readers.image_boxes(named_files.read_named(spark, path))
    return boxes.join(counts, F.col("slug").eqNullSafe(F.col("_slug"))).select("dataset", "slug", "image", "class_id", "cx", "cy", "w", "h", "files")


def image_box_stream(spark, sf):
    """Files arrive in two commits and are read as a stream: boxes by folder."""
    path, boxes = shared_dir(spark, "box-stream"), _part_boxes(spark, sf)
    for side in (0, 1):
        writers.image_boxes(boxes.filter(F.col("image").cast("long") % 2 == side), f"{path}/in")
        rows = readers.image_boxes(named_files.stream_named(spark, f"{path}/in"))
        rows.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("slug").agg(F.countDistinct("image").alias("images"), F.count("*").alias("boxes"))


def annotation_document(spark, sf):
    """Regions as images, nations as their annotations: one document there and back."""
    path, r, n = shared_dir(spark, "document"), table(spark, sf, "region"), table(spark, sf, "nation")
    images = r.select(F.col("r_regionkey").cast("long").alias("id"), F.concat("r_name", F.lit(".jpg")).alias("file_name"), F.lit(10).alias("width"), F.lit(20).alias("height"))
    box = F.array(*(F.lit(float(x)) for x in (1, 2)), F.col("n_nationkey").cast("double"), F.lit(4.0))
    made = n.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("image_id"), F.lit(1).alias("category_id"), box.alias("bbox"), (F.col("n_nationkey") * 4.0).cast("double").alias("area"), F.lit(0).alias("iscrowd"))
    kinds = n.select(F.lit(1).alias("id"), F.lit("nation").alias("name"), F.lit("place").alias("supercategory")).distinct()
    writers.coco_document(images, made, kinds, path)
    doc = readers.coco(spark, path)
    a, i, c = doc["annotations"], doc["images"], doc["categories"]
    return a.join(i.select(F.col("id").alias("image_id"), "file_name"), "image_id").join(c.select(F.col("id").alias("category_id"), "name"), "category_id").select("id", "file_name", "name", "x", "y", "w", "h", "area")


def large_document(spark, sf):
    """Orders as images and their line items as annotations: one document, written and read in parts."""
    path, o, li = f"{shared_dir(spark, 'large')}/document.json", table(spark, sf, "orders"), table(spark, sf, "lineitem")
    images = o.select(F.col("o_orderkey").cast("long").alias("id"), F.concat(F.lit('a"\\{['), "o_orderpriority").alias("file_name"), F.lit(10).alias("width"), F.lit(20).alias("height"))
    box = F.array(*(F.col(c).cast("double") for c in ("l_quantity", "l_tax", "l_discount", "l_linenumber")))
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long")
    made = li.select(key.alias("id"), F.col("l_orderkey").cast("long").alias("image_id"), F.lit(1).alias("category_id"), box.alias("bbox"), F.col("l_quantity").cast("double").alias("area"), F.lit(0).alias("iscrowd"))
    kinds = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("place").alias("supercategory"))
    writers.coco_file(images, made, kinds, path)
    doc = readers.coco_ranges(spark, path, 1 << 20)
    counts = doc["annotations"].groupBy("image_id").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("h").alias("h"))
    own = doc["images"].join(counts, F.col("id") == F.col("image_id"), "left").crossJoin(doc["categories"].agg(F.max("name").alias("last")))
    return own.select("id", "file_name", F.coalesce("n", F.lit(0)).alias("n"), "x", "h", "last")


def large_registry(spark, sf):
    """Customers by name as one JSON object, written and read in parts."""
    path, c = f"{shared_dir(spark, 'large')}/registry.json", table(spark, sf, "customer")
    writers.registry_file(c.select(F.concat("c_name", F.lit('"é')).alias("plant_key"), F.col("c_mktsegment").alias("plant_common"), F.array("c_name", F.lit("}]")).alias("butterfly_species")), path)
    return readers.registry_ranges(spark, path, 1 << 16).select("plant_key", "plant_common", F.array_join("butterfly_species", ",").alias("species"))


def registry_stored(spark, sf):
    """A stored registry that events reach in three upserts."""
    entries = rows.registry_entries(table(spark, sf, "events"))
    kept = Registry(spark, shared_dir(spark, "stored-registry"), "user_id", "long", {"event_type": "string", "day": "string"}, {"types": "array<string>", "days": "array<string>"})
    last = entries.agg(F.max("event_id")).first()[0]
    for i in range(3):
        kept.upsert(entries.filter(F.col("event_id").between(last * i // 3 + (i > 0), last * (i + 1) // 3)), "event_id")
    return rows.registry_row(kept.read())


def report_file(spark, sf):
    """A nested report as JSON, written and read back."""
    path, e = shared_dir(spark, "report"), table(spark, sf, "events")
    kinds = e.groupBy("event_type").agg(F.count("*").alias("n"))
    whole = kinds.agg(F.struct(F.sum("n").alias("rows"), F.count("*").alias("kinds")).alias("totals"), F.array_sort(F.collect_list(F.struct("event_type", "n"))).alias("kinds"))
    writers.report(whole, path)
    got = spark.read.schema("totals struct<rows:long,kinds:long>, kinds array<struct<event_type:string,n:long>>").json(path)
    return got.select("totals.rows", F.col("totals.kinds").alias("n_kinds"), F.inline("kinds"))


def sketched_audit(spark, sf):
    """Daily sketches of events, kept in two steps and merged, beside exact figures: whether each is within its bound."""
    e = table(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")).withColumn("value", F.col("value").cast("double"))
    kept = sketches.Audit(spark, shared_dir(spark, "sketches"), "day", ["event_type", "user_id", "event_id"], ["value"])
    middle = F.substring("day", 10, 1).cast("int") < 5
    kept.add(e.filter(middle))
    kept.add(e.filter(~middle))
    exact = e.agg(*(F.countDistinct(c).alias(c) for c in ("event_type", "user_id", "event_id"))).unpivot([], ["event_type", "user_id", "event_id"], "field", "exact")
    distinct = kept.distinct().join(exact, "field").select(F.concat(F.lit("distinct "), "field").alias("what"), "rows", (F.abs(F.col("distinct") - F.col("exact")) <= 0.02 * F.col("exact") + 1).alias("near"))
    counts = e.groupBy(F.col("event_type").alias("value")).agg(F.count("*").alias("exact"))
    common = kept.commonest("event_type", 3).join(counts, "value").select(F.concat(F.lit("common "), "value").alias("what"), F.col("n").alias("rows"), (F.col("n") == F.col("exact")).alias("near"))
    at = kept.quantiles("value", [0.1, 0.5, 0.9]).withColumnRenamed("value", "_v")
    below = e.select("value").crossJoin(F.broadcast(at)).groupBy("rank").agg(F.count("value").alias("rows"), F.sum((F.col("value") < F.col("_v")).cast("long")).alias("less"), F.sum((F.col("value") <= F.col("_v")).cast("long")).alias("most"))
    slack = 0.02 * F.col("rows")
    order = below.select(F.concat(F.lit("quantile "), F.col("rank").cast("string")).alias("what"), "rows", ((F.col("less") <= F.col("rank") * F.col("rows") + slack) & (F.col("most") >= F.col("rank") * F.col("rows") - slack)).alias("near"))
    return distinct.union(common).union(order)


def annotation_tables(spark, sf):
    path, o, li = shared_dir(spark, "tables"), table(spark, sf, "orders"), table(spark, sf, "lineitem")
    images = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("file_name"))
    writers.coco_tables(images, li.select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("category_id")), li.select(F.col("l_linenumber").alias("id")).distinct(), path)
    read = lambda name, ddl: spark.read.schema(ddl).json(f"{path}/{name}")
    counts = read("annotations", "image_id long, category_id long").groupBy("image_id").agg(F.count("*").alias("n"))
    return read("images", "id long, file_name string").join(counts, F.col("id") == F.col("image_id"), "left").select("id", "file_name", F.coalesce("n", F.lit(0)).alias("n"))


def classes(spark, sf):
    path = shared_dir(spark, "classes")
    made = features.class_ids([table(spark, sf, "documents").select(F.col("source").alias("slug")), table(spark, sf, "part").select(F.col("p_brand").alias("slug"))], "slug")
    writers.class_list(made, path)
    return readers.class_list(spark, path)


def registry(spark, sf):
    """Nations as one JSON object by key."""
    path, n = shared_dir(spark, "registry"), table(spark, sf, "nation")
    entry = F.struct(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("plant_common"), F.array("n_name", F.lit("x")).alias("butterfly_species"))
    n.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", entry)))).alias("value")).coalesce(1).write.text(path)  # 25 entries
    return readers.registry(spark, path).select("plant_key", "plant_common", F.array_join("butterfly_species", ",").alias("species"))


def metrics_file(spark, sf):
    """A row per day, appended in two steps, doubles at four decimals."""
    path, e = shared_dir(spark, "metrics"), table(spark, sf, "events")
    days = e.groupBy(F.date_format("ts", "yyyyMMdd").cast("int").alias("epoch")).agg(F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).alias("train_loss"), F.max("value").cast("double").alias("val_loss"))
    full = days.select("epoch", "train_loss", "val_loss", *(F.lit(None).cast("double").alias(c) for c in ("train_acc", "val_acc", "val_f1", "val_precision", "lr")))
    for part in (0, 1):
        writers.append_metrics(full.filter(F.col("epoch") % 2 == part), path)
    return readers.run_metrics(spark, path).select("epoch", "train_loss", "val_loss", "lr")


def manifest(spark, sf):
    path, d = shared_dir(spark, "manifest"), table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    status = F.when(F.col("toxic") == 1, "failed").when(F.col("toxic") == 0, "processed").otherwise("skipped")
    writers.manifest(d.select("source", status.alias("status")), "source", "status", path)
    return spark.read.schema("source string, processed long, skipped long, failed long").json(path)


def stream_new(spark, sf):
    """Documents arrive as a stream, twice; each text is processed once."""
    path, d = shared_dir(spark, "stream"), table(spark, sf, "documents").select("doc_id", "text")
    n = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")), d.rdd.getNumPartitions())  # files and tasks follow the size
    d.repartition(n).write.parquet(f"{path}/in")
    for _ in range(2):
        d.repartition(n).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", -(-n // 2)).parquet(f"{path}/in")
        incremental.process_new(stream, lambda x: x.select("doc_id", F.length("text").alias("size")), f"{path}/out", f"{path}/manifest", "doc_id", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("doc_id", "size")


def _released(spark, sf, name, made):
    """Events arrive four times, a day and more out of order, then two rows from far later; what a stream makes of them.

    Each arrival is one micro-batch: as many files as a trigger takes, each with a row of user -1 so that none is missing.
    """
    path, e = shared_dir(spark, name), table(spark, sf, "events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    first, last = (r.cast("long") for r in (F.min("ts"), F.max("ts")))
    span = e.agg(first.alias("a"), last.alias("b")).first()
    jittered = F.unix_timestamp("ts") + F.pmod(F.xxhash64("event_id"), F.lit(100_000))
    slot = F.floor((jittered - span.a) * 4 / (span.b - span.a + 100_001))
    n = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    mark = lambda s: spark.range(0, n, 1, n).select(F.lit(-1).cast("long").alias("user_id"), (-F.col("id") - 1).alias("event_id"), F.lit("end").alias("event_type"), F.timestamp_seconds(F.lit(s)).alias("ts"), F.col("id").alias("_file"))
    for i in range(4):
        rows = e.filter(slot == i).withColumn("_file", F.pmod(F.xxhash64("event_id", F.lit("file")), F.lit(n))).unionByName(mark(span.a))
        rows.repartitionById(n, F.col("_file").cast("int")).drop("_file").write.mode("append").parquet(f"{path}/in")
    for far in (1000, 2000):
        mark(span.b + far * 86_400).drop("_file").write.mode("append").parquet(f"{path}/in")
    out = made(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", n).parquet(f"{path}/in"))
    out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out").filter("user_id >= 0")


def stream_leases(spark, sf):
    return _released(spark, sf, "stream-leases", lambda e: ordered.lease_grants(e, "user_id", "ts", 36_000, "2 days"))


def stream_breaker(spark, sf):
    ok = F.col("event_type") != "error"
    return _released(spark, sf, "stream-breaker", lambda e: ordered.circuit_breaker(e.withColumn("ok", ok), "user_id", "ts", "event_id", "ok", 2, 3, "2 days", 1000 * 86_400))


def stream_counts(spark, sf):
    """Running counts of a stream, refreshed with each micro-batch."""
    path, d = shared_dir(spark, "progress"), table(spark, sf, "documents").select("source", "lang")
    d.repartition(4).write.parquet(f"{path}/in")
    counts = incremental.progress(spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"), "source", "lang")
    refresh = lambda df, _: df.write.mode("overwrite").parquet(f"{path}/out")
    counts.writeStream.outputMode("complete").foreachBatch(refresh).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


def overlay_items(spark, sf):
    """Recognised pieces of orders: the parsers that take an array."""
    o = table(spark, sf, "orders")
    code = F.concat(F.lit("Media code: x"), F.col("o_custkey").cast("string"))
    top = X.parse_top_items(F.array("o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, code).otherwise(F.col("o_orderstatus")), code))
    day = F.date_format("o_orderdate", "yyyy/MM/dd")
    bottom = X.parse_bottom_items(F.array(F.when(F.col("o_orderkey") % 2 == 0, "male").otherwise("Near Pune"), F.concat(F.lit("Fort "), F.col("o_custkey").cast("string")), day, F.concat(F.lit("©Zed "), F.col("o_orderstatus"))))
    plant = X.parse_top(F.concat_ws("\n", "o_orderpriority", "o_orderpriority", code), "family", differs=False)
    rows = o.select("o_orderkey", top.alias("t"), bottom.alias("b"), plant.alias("p"))
    return rows.select("o_orderkey", "t.scientific_name", "t.common_name", "t.media_code", "b.sex", "b.location", "b.date", "b.credit", F.col("p.family").alias("family"))


OVERLAY_SQL = """SELECT o_orderkey, o_orderpriority AS scientific_name, CASE WHEN o_orderkey % 3 <> 0 AND o_orderstatus <> o_orderpriority THEN o_orderstatus END AS common_name, 'x' || o_custkey AS media_code,
 CASE WHEN o_orderkey % 2 = 0 THEN 'Male' END AS sex, CASE WHEN o_orderkey % 2 = 0 THEN 'Fort ' || o_custkey ELSE 'Near Pune Fort ' || o_custkey END AS location, strftime(o_orderdate, '%Y/%m/%d') AS date, 'Zed ' || o_orderstatus AS credit,
 o_orderpriority AS family FROM orders"""


def small_texts(spark, sf):
    """Names, digits, placeholders, host lists and maps."""
    p = table(spark, sf, "part")
    even = F.col("p_partkey") % 2 == 0
    first, second = F.create_map(F.lit("a"), "p_brand", F.lit("b"), "p_type"), F.create_map(F.lit("b"), "p_name", F.lit("c"), F.lit("z"))
    both = X.merge_maps(first, second)
    return p.select(
        "p_partkey", X.display_name(F.when(even, F.col("p_brand")), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type"))).alias("display"),
        X.digits_to_long(F.when(even, F.col("p_partkey").cast("string")).otherwise(F.col("p_brand"))).alias("digits"),
        X.blank_to_null(F.when(even, F.lit(" NaN ")).otherwise(F.col("p_brand"))).alias("value"),
        X.join_hosts(F.array("p_brand", F.lit("http://x"), "p_type")).alias("hosts"), X.map_get(both, "b").alias("b"), X.map_get(both, "d").alias("d"), F.array_join(F.array_sort(F.map_keys(both)), "").alias("keys"),
    )


SMALL_SQL = """SELECT p_partkey, nullif(trim(concat_ws(' ', CASE WHEN p_partkey % 2 = 0 THEN p_brand END, CASE WHEN p_partkey % 3 = 0 THEN p_type END)), '') AS display, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS digits,
 CASE WHEN p_partkey % 2 <> 0 THEN p_brand END AS value, p_brand || ', ' || p_type AS hosts, p_name AS b, 'Unknown' AS d, 'abc' AS keys FROM part"""

QUERIES = {
    "metadata_files": (
        metadata,
        """SELECT 'butterflies' AS dataset, doc_id AS image_id, source AS species, md5(nullif(text, '')) AS location, lang AS sex, NULL AS butterfly_hosts FROM documents
 UNION ALL SELECT 'plants', p_partkey, p_name, NULL, NULL, p_type FROM part""",
    ),
    "json_lines": (json_lines, "SELECT 'f' || doc_id AS file_name, arg_max(source, doc_id) AS page_title, arg_max(lang, doc_id) AS family FROM documents GROUP BY 1"),
    "json_appended": (json_appended, "SELECT doc_id, md5(text) AS text FROM documents"),
    "split_files": (split_files, f"SELECT 'f' || doc_id || '.jpg' AS filename, split FROM ({split_sql()})"),
    "box_lines": (box_lines, "SELECT l_returnflag AS slug, CAST(l_orderkey AS VARCHAR) AS image, printf('%d %.6f 0.500000 0.250000 0.125000', l_linenumber, CAST(l_quantity AS DOUBLE) / 100) AS line FROM lineitem"),
    "image_box_files": (
        image_box_files,
        """SELECT 'parts' AS dataset, p_brand AS slug, CAST(l_partkey AS VARCHAR) AS image, l_linenumber AS class_id, 0.5 AS cx, l_quantity / 100 AS cy, l_discount AS w, l_tax AS h, count(DISTINCT l_partkey) OVER (PARTITION BY p_brand) AS files
 FROM lineitem JOIN part ON p_partkey = l_partkey""",
    ),
    "image_box_stream": (image_box_stream, "SELECT p_brand AS slug, count(DISTINCT l_partkey) AS images, count(*) AS boxes FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1"),
    "annotation_document": (annotation_document, "SELECT n_nationkey AS id, r_name || '.jpg' AS file_name, 'nation' AS name, 1 AS x, 2 AS y, n_nationkey AS w, 4 AS h, n_nationkey * 4 AS area FROM nation JOIN region ON r_regionkey = n_regionkey"),
    "large_document": (
        large_document,
        """SELECT o_orderkey AS id, 'a"\\{[' || o_orderpriority AS file_name, count(l_orderkey) AS n, sum(CAST(l_quantity AS DOUBLE)) AS x, sum(CAST(l_linenumber AS DOUBLE)) AS h, (SELECT max(n_name) FROM nation) AS last
 FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    ),
    "large_registry": (large_registry, """SELECT c_name || '"é' AS plant_key, c_mktsegment AS plant_common, c_name || ',}]' AS species FROM customer"""),
    "registry_stored": (registry_stored, rows.QUERIES["registry_upsert"][1]),
    "report_file": (report_file, "SELECT sum(count(*)) OVER () AS rows, count(*) OVER () AS n_kinds, event_type, count(*) AS n FROM events GROUP BY event_type"),
    "sketched_audit": (
        sketched_audit,
        """WITH t AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)
 SELECT 'distinct ' || f AS what, count(*) AS rows, true AS near FROM events, (VALUES ('event_type'), ('user_id'), ('event_id')) v(f) GROUP BY 1
 UNION ALL SELECT 'common ' || event_type, n, true FROM t UNION ALL SELECT 'quantile ' || q, count(value), true FROM events, (VALUES ('0.1'), ('0.5'), ('0.9')) v(q) GROUP BY 1""",
    ),
    "annotation_tables": (annotation_tables, "SELECT o_orderkey AS id, o_orderstatus AS file_name, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2"),
    "class_file": (classes, "SELECT row_number() OVER (ORDER BY source, slug) - 1 AS class_id, slug FROM (SELECT 0 AS source, source AS slug FROM documents UNION SELECT 1, p_brand FROM part)"),
    "registry_file": (registry, "SELECT n_name AS plant_key, 'r' || n_regionkey AS plant_common, n_name || ',x' AS species FROM nation"),
    "metrics_file": (
        metrics_file,
        """SELECT CAST(strftime(ts, '%Y%m%d') AS INT) AS epoch, round(avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0 END), 4) AS train_loss, round(max(value)::DOUBLE, 4) AS val_loss, NULL AS lr FROM events GROUP BY 1""",
    ),
    "manifest_file": (
        manifest,
        """SELECT source, count(*) FILTER (toxic = 0) AS processed, count(*) FILTER (toxic IS NULL) AS skipped, count(*) FILTER (toxic = 1) AS failed FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""",
    ),
    "stream_new": (stream_new, "SELECT doc_id, length(any_value(text)) AS size FROM documents GROUP BY 1"),
    "stream_leases": (stream_leases, rows.QUERIES["lease_grants"][1]),
    "stream_breaker": (stream_breaker, rows.QUERIES["circuit_breaker"][1]),
    "stream_counts": (stream_counts, "SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2"),
    "overlay_items": (overlay_items, OVERLAY_SQL),
    "small_texts": (small_texts, SMALL_SQL),
}
