"""Registered queries: distributions, coverage, totals, evaluation. name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.dims import STATES, ZONE_STATES, ZONES, month_name, state_zones
from tessera.functions.numbers import arg_max, cyclic_month, month_of, percent
from tessera.operators import audit, evaluation, features, splits, tables
from tessera.plans.base import on, table

SPLITS = ["train", "val", "test"]


def date_text():
    """A date text with gaps and damage by rule of the key."""
    key = F.col("o_orderkey")
    whole, bad, dashes = F.date_format("o_orderdate", "yyyy/MM/dd"), F.date_format("o_orderdate", "yyyy/'77'/dd"), F.date_format("o_orderdate", "yyyy-MM-dd")
    return F.when(key % 11 == 0, F.lit(None)).when(key % 7 == 0, bad).when(key % 13 == 0, dashes).otherwise(whole)


DATE_SQL = """CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '%Y/77/%d')
 WHEN o_orderkey % 13 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y/%m/%d') END"""
SPLIT_SQL = """SELECT doc_id, {cls}, CASE WHEN rn <= a THEN 'train' WHEN rn <= a + b THEN 'val' ELSE 'test' END AS split FROM (
 SELECT doc_id, {cls}, rn, greatest(1, floor(n * {train}::DOUBLE)) AS a, floor(n * {val}::DOUBLE) AS b FROM (
  SELECT doc_id, {cls}, count(*) OVER (PARTITION BY {cls}) AS n,
   row_number() OVER (PARTITION BY {cls} ORDER BY md5('42:' || doc_id), doc_id) AS rn FROM (SELECT DISTINCT doc_id, {cls} FROM {rows})))"""


def split_sql(cls: str = "lang", rows: str = "documents", train: str = "0.7", val: str = "0.15") -> str:
    return SPLIT_SQL.format(cls=cls, rows=rows, train=train, val=val)


#: A state for each nation, by its number; each fifth has a name that no zone has.
NATION_STATES = [(i, "Atlantis" if i % 5 == 4 else STATES[i]) for i in range(25)]
NATION_SQL = "(VALUES " + ", ".join(f"({i}, '{s}')" for i, s in NATION_STATES) + ") AS st(k, state)"
ZONE_SQL = "(VALUES " + ", ".join(f"('{s}', '{z}', {i})" for i, z in enumerate(ZONES[:-1]) for s in ZONE_STATES[i]) + ") AS z(state, zone, zone_idx)"


def customer_states(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    states = spark.createDataFrame(NATION_STATES, "n_nationkey int, state string")
    return c.join(F.broadcast(n.select("n_nationkey")), c.c_nationkey == n.n_nationkey).join(F.broadcast(states), "n_nationkey").select("c_custkey", "state")


def zones(spark, sf):
    out = customer_states(spark, sf).join(F.broadcast(state_zones(spark)), "state", "left")
    return audit.value_counts(out.select(F.coalesce("zone", F.lit("Unknown")).alias("zone"), F.coalesce("zone_idx", F.lit(8)).alias("zone_idx")), ["zone", "zone_idx"])


def predictions(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("target"), F.slice("embedding", 1, 10).alias("logits"))
    return e.withColumn("pred", arg_max(F.col("logits")))


#: sums and scores of doubles are compared at this many digits
def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


PRED_SQL = "(SELECT vec_id, label AS target, embedding[1:10] AS logits, list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS pred FROM embeddings)"
PER_CLASS_SQL = f"""WITH p AS {PRED_SQL}, t AS (SELECT target AS label, count(*) AS support, count(*) FILTER (target = pred) AS hits FROM p GROUP BY 1),
 q AS (SELECT pred AS label, count(*) AS predicted FROM p GROUP BY 1),
 j AS (SELECT coalesce(t.label, q.label) AS label, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, coalesce(hits, 0) AS hits FROM t FULL JOIN q ON t.label = q.label),
 c AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS prec, CASE WHEN support = 0 THEN 0 ELSE hits / support END AS rec,
  CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * hits / (support + predicted) END AS f1 FROM j)"""


def train_counts(spark, sf):
    return table(spark, sf, "embeddings").filter("vec_id % 3 <> 0 and (label <> 7 or vec_id % 9 = 1)").groupBy("label").agg(F.count("*").alias("n"))


COUNTS_SQL = "(SELECT {c}, count(*) AS n FROM {t} GROUP BY 1)"

QUERIES = {
    "value_distribution": (
        on("documents")(lambda d: audit.distribution(d, "lang")),
        "SELECT trim(lang) AS value, count(*) AS n FROM documents WHERE trim(lang) <> '' GROUP BY 1",
    ),
    "distribution_topn_tail": (
        on("lineitem")(lambda d: audit.top_with_tail(audit.distribution(d, "l_suppkey"), "value", 10)),
        """WITH c AS (SELECT CAST(l_suppkey AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS rank FROM c)
 SELECT rank, value, n FROM r WHERE rank <= 10 UNION ALL SELECT 11, '(' || count(*) || ' more)', sum(n) FROM r WHERE rank > 10 HAVING count(*) > 0""",
    ),
    "multi_field_distribution": (
        on("documents")(lambda d: audit.distributions(d, ["lang", "source"])),
        "SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2",
    ),
    "value_counts_pct": (
        on("orders")(lambda o: audit.value_counts(o, ["o_orderstatus", "o_orderpriority"])),
        "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round_even(100.0::DOUBLE * count(*) / (SELECT count(*) FROM orders), 1) AS pct FROM orders GROUP BY 1, 2",
    ),
    "missing_coverage": (
        on("documents", "labels")(lambda d, l: audit.missing_fields(d.join(l, "doc_id", "left"), ["source", "quality", "toxic"])),
        "WITH j AS (SELECT d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)) "
        + " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) - count({c}) AS missing, count({c}) AS present, round_even(100.0::DOUBLE * (count(*) - count({c})) / count(*), 1) AS pct FROM j" for c in ("source", "quality", "toxic")),
    ),
    "class_summary": (
        on("lineitem")(lambda d: audit.class_summary(d.groupBy("l_suppkey").agg(F.count("*").alias("n")), "l_suppkey")),
        f"""WITH c AS {COUNTS_SQL.format(c='l_suppkey', t='lineitem')} SELECT count(*) AS classes, sum(n) AS rows, avg(n) AS mean, quantile_cont(n, 0.5) AS median, min(n) AS least,
 (SELECT l_suppkey FROM c ORDER BY n, l_suppkey LIMIT 1) AS least_class, max(n) AS largest, (SELECT l_suppkey FROM c ORDER BY n DESC, l_suppkey LIMIT 1) AS largest_class FROM c""",
    ),
    "sparse_dense_thresholds": (
        on("lineitem")(lambda d: audit.threshold_table(d.groupBy("l_partkey").agg(F.count("*").alias("n")))),
        f"""WITH c AS {COUNTS_SQL.format(c='l_partkey', t='lineitem')} SELECT t AS threshold, count(*) FILTER (n < t) AS classes_below, coalesce(sum(n) FILTER (n < t), 0) AS rows_below,
 count(*) FILTER (n >= t) AS classes_from, coalesce(sum(n) FILTER (n >= t), 0) AS rows_from, round_even(100.0::DOUBLE * count(*) FILTER (n < t) / count(*), 1) AS pct_below
 FROM c, (VALUES (10), (20), (30), (50), (100)) v(t) GROUP BY t""",
    ),
    "month_histogram_text": (
        on("orders")(lambda o: audit.months_as_text(o.withColumn("date", date_text()), "date")),
        f"SELECT split_part(d, '/', 2) AS month, count(*) AS n FROM (SELECT {DATE_SQL} AS d FROM orders) WHERE contains(d, '/') GROUP BY 1",
    ),
    "month_histogram_valid": (
        on("orders")(lambda o: audit.months_checked(o.withColumn("date", date_text()), "date")),
        f"""SELECT month(coalesce(try_strptime(d, '%Y/%m/%d'), try_strptime(d, '%Y-%m-%d'))) AS month, count(*) AS n,
 count(*) FILTER (coalesce(try_strptime(d, '%Y/%m/%d'), try_strptime(d, '%Y-%m-%d')) IS NULL AND d IS NOT NULL) AS invalid FROM (SELECT {DATE_SQL} AS d FROM orders) GROUP BY 1""",
    ),
    "month_names": (
        on("orders")(lambda o: o.select(month_name(month_of(date_text())).alias("month_name")).groupBy("month_name").agg(F.count("*").alias("n"))),
        f"SELECT monthname(coalesce(try_strptime(d, '%Y/%m/%d'), try_strptime(d, '%Y-%m-%d'))) AS month_name, count(*) AS n FROM (SELECT {DATE_SQL} AS d FROM orders) GROUP BY 1",
    ),
    "zone_lookup": (
        zones,
        f"""WITH j AS (SELECT coalesce(zone, 'Unknown') AS zone, coalesce(zone_idx, 8) AS zone_idx FROM customer JOIN {NATION_SQL} ON c_nationkey = st.k LEFT JOIN {ZONE_SQL} ON z.state = st.state)
 SELECT zone, zone_idx, count(*) AS n, round_even(100.0::DOUBLE * count(*) / (SELECT count(*) FROM j), 1) AS pct FROM j GROUP BY 1, 2""",
    ),
    "unmapped_values": (
        lambda spark, sf: tables.unmatched(customer_states(spark, sf), F.broadcast(state_zones(spark)), "state"),
        f"SELECT DISTINCT st.state FROM customer JOIN {NATION_SQL} ON c_nationkey = st.k WHERE st.state NOT IN (SELECT state FROM {ZONE_SQL})",
    ),
    "split_distribution": (
        on("documents")(lambda d: audit.in_fixed_order(splits.stratified_split(d, "doc_id", "lang").groupBy("split").agg(F.count("*").alias("n")), "split", [*SPLITS, "extra"])),
        f"""WITH s AS (SELECT split, count(*) AS n FROM ({split_sql()}) GROUP BY 1) SELECT position, v.split, coalesce(n, 0) AS n, round_even(100.0::DOUBLE * coalesce(n, 0) / (SELECT sum(n) FROM s), 1) AS pct
 FROM (VALUES (0, 'train'), (1, 'val'), (2, 'test'), (3, 'extra')) v(position, split) LEFT JOIN s ON s.split = v.split""",
    ),
    "class_by_split": (
        on("documents")(lambda d: audit.coverage(splits.stratified_split(d, "doc_id", "source"), "source", "split")),
        f"SELECT split, count(DISTINCT source) AS classes, count(*) AS n FROM ({split_sql('source')}) GROUP BY 1",
    ),
    "missing_class_by_split": (
        on("part")(lambda p: audit.missing_pairs(splits.stratified_split(p.select(F.col("p_partkey").alias("doc_id"), F.concat("p_brand", F.lit("-"), (F.col("p_partkey") % 50).cast("string")).alias("cls")), "doc_id", "cls"), "cls", "split", SPLITS)),
        f"""WITH s AS ({split_sql('cls', "(SELECT p_partkey AS doc_id, p_brand || '-' || (p_partkey % 50) AS cls FROM part)")}), g AS (
 SELECT c.cls, v.split, row_number() OVER (PARTITION BY v.split ORDER BY c.cls) AS r FROM (SELECT DISTINCT cls FROM s) c, (VALUES ('train'), ('val'), ('test')) v(split)
 WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.cls = c.cls AND s.split = v.split))
 SELECT split, count(*) AS missing, string_agg(cls, ',' ORDER BY cls) FILTER (r <= 5) AS examples FROM g GROUP BY 1""",
    ),
    "head_tail": (
        on("lineitem")(lambda d: audit.head_and_tail(d.groupBy("l_partkey").agg(F.count("*").alias("n")), "l_partkey")),
        f"""WITH c AS {COUNTS_SQL.format(c='l_partkey', t='lineitem')} SELECT * FROM (SELECT 'head' AS side, l_partkey AS value, n FROM c ORDER BY n DESC, l_partkey LIMIT 10)
 UNION ALL SELECT * FROM (SELECT 'tail' AS side, l_partkey AS value, n FROM c ORDER BY n, l_partkey LIMIT 10)""",
    ),
    "folder_mismatch": (
        on("orders", "lineitem")(lambda o, l: audit.folder_mismatch(o.select(F.col("o_orderkey").alias("k")), l.select(F.col("l_orderkey").alias("k")), "k")),
        """SELECT coalesce(a.k, b.k) AS k, coalesce(files, 0) AS files, coalesce(rows, 0) AS rows FROM (SELECT o_orderkey AS k, count(*) AS files FROM orders GROUP BY 1) a
 FULL JOIN (SELECT l_orderkey AS k, count(*) AS rows FROM lineitem GROUP BY 1) b ON a.k = b.k WHERE coalesce(files, 0) <> coalesce(rows, 0)""",
    ),
    "stage_dashboard": (
        on("documents", "labels")(lambda d, l: audit.stage_dashboard({"raw": d, "labelled": d.join(l, "doc_id"), "toxic": d.join(l.filter("toxic = 1"), "doc_id")}, "source")),
        """SELECT source, count(*) AS raw, count(l.doc_id) AS labelled, count(*) FILTER (toxic = 1) AS toxic, round_even(100.0::DOUBLE * count(l.doc_id) / count(*), 1) AS labelled_pct,
 round_even(100.0::DOUBLE * count(*) FILTER (toxic = 1) / count(*), 1) AS toxic_pct FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""",
    ),
    "folder_pending": (
        on("documents", "labels")(lambda d, l: audit.folder_pending(d, d.join(l, "doc_id"), "source")),
        "SELECT source, count(*) AS raw, count(l.doc_id) AS done FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1 HAVING count(l.doc_id) < count(*)",
    ),
    "status_totals": (
        on("orders")(lambda o: audit.status_totals(o, "o_orderpriority", "o_orderstatus", ["F", "O", "P"])),
        'SELECT o_orderpriority, count(*) FILTER (o_orderstatus = \'F\') AS "F", count(*) FILTER (o_orderstatus = \'O\') AS "O", count(*) FILTER (o_orderstatus = \'P\') AS "P" FROM orders GROUP BY 1',
    ),
    "recommendation": (
        on("lineitem")(lambda d: audit.recommendation(d.groupBy("l_partkey").agg(F.count("*").alias("n")))),
        f"""SELECT *, CASE WHEN under_mid > 30 THEN 'dual head' WHEN under_low > 15 THEN 'consider dual head' ELSE 'single head' END AS advice FROM (
 SELECT count(*) AS classes, count(*) FILTER (n < 50) AS under_mid, count(*) FILTER (n < 30) AS under_low FROM {COUNTS_SQL.format(c='l_partkey', t='lineitem')})""",
    ),
    "sync_totals": (
        on("documents", "labels")(lambda d, l: audit.sync_totals(d.select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("k")), l.select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("k")), "k", 100)),
        """WITH a AS (SELECT DISTINCT lpad(doc_id::VARCHAR, 9, '0') AS k FROM documents), b AS (SELECT DISTINCT lpad(doc_id::VARCHAR, 9, '0') AS k FROM labels), g AS (SELECT k FROM a WHERE k NOT IN (SELECT k FROM b))
 SELECT (SELECT count(*) FROM a) AS n_local, (SELECT count(*) FROM b) AS n_remote, (SELECT count(*) FROM g) AS n_missing,
 (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT k FROM g ORDER BY k LIMIT 10)) AS first_missing, CAST(ceil((SELECT count(*) FROM g) / 100) AS BIGINT) AS batches""",
    ),
    "event_error_rate": (
        on("events")(lambda e: e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("n")).withColumn("rate", percent(F.col("errors"), F.col("n")))),
        "SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(*) AS n, round_even(100.0::DOUBLE * count(*) FILTER (event_type = 'error') / count(*), 1) AS rate FROM events GROUP BY 1",
    ),
    "cyclic_month": (
        on("orders")(lambda o: rounded(o.select("o_orderkey", cyclic_month(month_of(date_text())).alias("_m")).select("o_orderkey", F.col("_m")[0].alias("month_sin"), F.col("_m")[1].alias("month_cos")), "month_sin", "month_cos")),
        f"""SELECT o_orderkey, round(CASE WHEN m IS NULL THEN 0 ELSE sin(m * (2 * pi() / 12)) END, 6) AS month_sin, round(CASE WHEN m IS NULL THEN 0 ELSE cos(m * (2 * pi() / 12)) END, 6) AS month_cos
 FROM (SELECT o_orderkey, month(coalesce(try_strptime(d, '%Y/%m/%d'), try_strptime(d, '%Y-%m-%d'))) AS m FROM (SELECT o_orderkey, {DATE_SQL} AS d FROM orders))""",
    ),
    "zone_index": (
        lambda spark, sf: customer_states(spark, sf).join(F.broadcast(state_zones(spark)), "state", "left").select("c_custkey", F.coalesce("zone_idx", F.lit(8)).alias("zone_idx")),
        f"SELECT c_custkey, coalesce(zone_idx, 8) AS zone_idx FROM customer JOIN {NATION_SQL} ON c_nationkey = st.k LEFT JOIN {ZONE_SQL} ON z.state = st.state",
    ),
    "class_index": (
        on("documents", "part")(lambda d, p: features.class_index([d.select(F.col("source").alias("c")), p.select(F.col("p_brand").alias("c"))], "c")),
        "SELECT c, row_number() OVER (ORDER BY c) - 1 AS label FROM (SELECT source AS c FROM documents UNION SELECT p_brand FROM part)",
    ),
    "class_ids": (
        on("documents", "part")(lambda d, p: features.class_ids([d.select(F.col("source").alias("slug")), p.select(F.col("p_brand").alias("slug"))], "slug")),
        "SELECT source, slug, row_number() OVER (ORDER BY source, slug) - 1 AS class_id FROM (SELECT 0 AS source, source AS slug FROM documents UNION SELECT 1, p_brand FROM part)",
    ),
    "class_counts": (
        on("documents", "labels")(lambda d, l: features.class_counts(d.join(l.filter("toxic = 1"), "doc_id", "left_semi"), "source", features.class_index([d], "source"))),
        """SELECT i.source, label, coalesce(n, 0) AS n FROM (SELECT source, row_number() OVER (ORDER BY source) - 1 AS label FROM (SELECT DISTINCT source FROM documents)) i
 LEFT JOIN (SELECT source, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1) c ON c.source = i.source""",
    ),
    "class_weights": (
        on("lineitem")(lambda d: rounded(features.class_weights(d.groupBy("l_suppkey").agg(F.count("*").alias("n"))), "weight")),
        f"SELECT l_suppkey, n, round(1 / (n + 1e-6::DOUBLE) / sum(1 / (n + 1e-6::DOUBLE)) OVER () * count(*) OVER (), 6) AS weight FROM {COUNTS_SQL.format(c='l_suppkey', t='lineitem')}",
    ),
    "balanced_weights": (
        on("documents")(lambda d: rounded(features.sampling_weights(d.select("doc_id", "source"), "source"), "draw_chance", digits=9)),
        """SELECT doc_id, source, round(1.0::DOUBLE / count(*) OVER (PARTITION BY source) / (SELECT count(DISTINCT source) FROM documents), 9) AS draw_chance FROM documents""",
    ),
    "balanced_sample": (
        on("documents")(lambda d: features.balanced_sample(d, "source", "doc_id", 1000)),
        """WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS i, count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT DISTINCT doc_id, source FROM documents WHERE source IS NOT NULL)),
 c AS (SELECT source, n, row_number() OVER (ORDER BY source) - 1 AS label FROM (SELECT DISTINCT source, n FROM r)),
 d AS (SELECT range AS draw, CAST('0x' || left(md5('42:' || range), 15) AS BIGINT) AS a, CAST('0x' || left(md5('43:' || range), 15) AS BIGINT) AS b FROM range(1000))
 SELECT draw, doc_id, r.source FROM d JOIN c ON c.label = d.a % (SELECT count(*) FROM c) JOIN r ON r.source = c.source AND r.i = d.b % c.n + 1""",
    ),
    "mean_loss": (
        on("events")(lambda e: rounded(e.groupBy("user_id").agg(audit.mean_or_zero(F.sum(F.when(F.col("event_type") == "error", F.col("value"))), F.count_if(F.col("event_type") == "error")).alias("loss")), "loss")),
        """SELECT user_id, round(coalesce(sum(value) FILTER (event_type = 'error'), 0) / greatest(count(*) FILTER (event_type = 'error'), 1), 6) AS loss FROM events GROUP BY 1""",
    ),
    "confusion": (lambda spark, sf: evaluation.confusion(predictions(spark, sf)), f"SELECT target, pred, count(*) AS n FROM {PRED_SQL} GROUP BY 1, 2"),
    "top_confusions": (
        lambda spark, sf: evaluation.top_confusions(predictions(spark, sf)),
        f"SELECT target, pred, count(*) AS n FROM {PRED_SQL} WHERE target <> pred GROUP BY 1, 2 ORDER BY n DESC, target DESC, pred DESC LIMIT 20",
    ),
    "error_classes": (
        lambda spark, sf: evaluation.error_classes(predictions(spark, sf), 5),
        f"SELECT target AS label, count(*) AS errors FROM {PRED_SQL} WHERE target <> pred GROUP BY 1 ORDER BY errors DESC, label LIMIT 5",
    ),
    "error_submatrix": (
        lambda spark, sf: evaluation.error_submatrix(predictions(spark, sf), 5),
        f"""WITH p AS {PRED_SQL}, f AS (SELECT target AS label FROM p WHERE target <> pred GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 5)
 SELECT target, pred, count(*) AS n FROM p WHERE target IN (SELECT label FROM f) AND pred IN (SELECT label FROM f) GROUP BY 1, 2""",
    ),
    "per_class_scores": (
        lambda spark, sf: rounded(evaluation.per_class(predictions(spark, sf)), "precision", "recall", "f1"),
        f'{PER_CLASS_SQL} SELECT label, support, predicted, hits, round(prec, 6) AS "precision", round(rec, 6) AS recall, round(f1, 6) AS f1 FROM c',
    ),
    "accuracy_metrics": (
        lambda spark, sf: rounded(evaluation.metrics(predictions(spark, sf)), "accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1"),
        f"""{PER_CLASS_SQL} SELECT round(sum(hits) / sum(support), 6) AS accuracy, round(avg(prec), 6) AS macro_precision, round(avg(rec), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
 round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM c""",
    ),
    "topk_accuracy": (
        lambda spark, sf: rounded(evaluation.topk_accuracy(predictions(spark, sf)), "top1", "top3", "top5"),
        f"""WITH r AS (SELECT vec_id, target, i, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS k FROM (SELECT vec_id, target, unnest(logits) AS v, generate_subscripts(logits, 1) - 1 AS i FROM {PRED_SQL}))
 SELECT round(avg(CAST(k <= 1 AS INT)), 6) AS top1, round(avg(CAST(k <= 3 AS INT)), 6) AS top3, round(avg(CAST(k <= 5 AS INT)), 6) AS top5 FROM r WHERE i = target""",
    ),
    "stratum_metrics": (
        lambda spark, sf: rounded(evaluation.strata(predictions(spark, sf).filter("vec_id % 3 = 0"), train_counts(spark, sf), 20), "accuracy", "macro_f1"),
        f"""WITH n AS (SELECT label, count(*) AS n FROM embeddings WHERE vec_id % 3 <> 0 AND (label <> 7 OR vec_id % 9 = 1) GROUP BY 1), k AS (SELECT CASE WHEN n >= 20 THEN 'dense' ELSE 'sparse' END AS stratum, label FROM n),
 p AS (SELECT coalesce(stratum, 'sparse') AS stratum, target, pred FROM {PRED_SQL} p LEFT JOIN k ON k.label = p.target WHERE vec_id % 3 = 0),
 t AS (SELECT stratum, target AS label, count(*) AS support, count(*) FILTER (target = pred) AS hits FROM p GROUP BY 1, 2), q AS (SELECT stratum, pred AS label, count(*) AS predicted FROM p GROUP BY 1, 2),
 j AS (SELECT coalesce(t.stratum, q.stratum) AS stratum, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, coalesce(hits, 0) AS hits FROM t FULL JOIN q ON t.label = q.label AND t.stratum = q.stratum)
 SELECT stratum, (SELECT count(*) FROM k WHERE k.stratum = j.stratum) AS classes, sum(support) AS samples, round(sum(hits) / sum(support), 6) AS accuracy, round(avg(2 * hits / (support + predicted)), 6) AS macro_f1 FROM j GROUP BY 1""",
    ),
}
