"""Registered queries of whole plans: enrichment, annotation, the statistics report, the audit and the evaluation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import boxes, splits
from tessera.plans import curation
from tessera.plans.base import table
from tessera.plans.reports import COUNTS_SQL, DATE_SQL, PER_CLASS_SQL, PRED_SQL, QUERIES as REPORTS, date_text, predictions, split_sql, train_counts
from tessera.plans.rows import image_sizes


def records(spark, sf):
    """Orders as files: customers (each second one) are known, the rest falls back to what the order says."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    files = o.select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("read_name"), F.when(F.col("o_orderkey") % 4 == 0, F.lit(" ")).otherwise(F.col("o_orderstatus")).alias("read_state"))
    known = c.filter("c_custkey % 2 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("k"), F.concat_ws(" ", "c_mktsegment", "c_name").alias("species"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("family"))
    name = lambda x: F.concat(F.lit("c"), x.cast("string"))
    fields = {"species": ("species", "read_name", None), "family": ("family", None, None), "state": (None, "read_state", None), "taxon": ("family", None, "Lepidoptera"), "source": (None, None, "site"), "split": (None, None, "")}
    return curation.enrich(files, "o_orderkey", [name(F.col("o_custkey")), name(F.col("o_custkey") + 3)], known, "k", fields, ["o_orderkey"])


RECORDS_SQL = """WITH f AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS read_state,
  CASE WHEN o_custkey % 2 = 0 AND o_custkey IN (SELECT c_custkey FROM customer) THEN o_custkey WHEN (o_custkey + 3) % 2 = 0 AND o_custkey + 3 IN (SELECT c_custkey FROM customer) THEN o_custkey + 3 END AS hit FROM orders)
 SELECT o_orderkey, CASE WHEN hit IS NOT NULL THEN c_mktsegment || ' ' || c_name ELSE o_orderpriority END AS species, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS family,
 CASE WHEN hit IS NULL THEN read_state END AS state, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END, 'Lepidoptera') AS taxon, 'site' AS source, '' AS split, row_number() OVER (ORDER BY o_orderkey) AS image_id
 FROM f LEFT JOIN customer ON c_custkey = hit"""


def detect(batch: pd.DataFrame) -> pd.DataFrame:
    """A rule in a detector's place: some images have no box, some two, and some cannot be read.

    It says so of most of these; each thousandth makes it fail.
    """
    bad = batch["image"] % 11 == 0
    if (batch["image"] % 11_000 == 0).any():
        raise ValueError("unreadable")
    one = batch[~bad & (batch["image"] % 5 != 0)]
    two = one[one["image"] % 3 == 0]
    rows = pd.concat([one.assign(cx=0.25, score=0.9), two.assign(cx=0.75, score=0.5), batch.loc[bad, ["image"]].assign(error="ValueError: unreadable")], ignore_index=True)
    return rows.assign(cy=rows["height"] / 2000, w=rows["width"] / 4000, h=0.5)


def annotations(spark, sf):
    return boxes.annotated(image_sizes(table(spark, sf, "orders")), detect).drop("error")


def annotation_errors(spark, sf):
    """Why images have the box of the whole image, with their number."""
    made = boxes.annotated(image_sizes(table(spark, sf, "orders")), detect).filter("fallback")
    return made.groupBy(F.coalesce("error", F.lit("nothing found")).alias("reason")).agg(F.count("*").alias("n"))


ANNOTATIONS_SQL = """WITH s AS (SELECT o_orderkey AS image, 600 + o_custkey % 21 * 20 AS width, 500 + o_custkey % 16 * 20 AS height FROM orders),
 b AS (SELECT image, 0.25::DOUBLE AS cx, height / 2000 AS cy, width / 4000 AS w, 0.5::DOUBLE AS h, 0.9::DOUBLE AS score, false AS fallback FROM s WHERE image % 5 <> 0 AND image % 11 <> 0),
 t AS (SELECT image, 0.75::DOUBLE, cy, w, h, 0.5::DOUBLE, false FROM b WHERE image % 3 = 0)
 SELECT * FROM b UNION ALL SELECT * FROM t UNION ALL SELECT image, 0.5, 0.5, 1.0, 1.0, NULL, true FROM s WHERE image % 5 = 0 OR image % 11 = 0"""


def stats(spark, sf):
    """Orders and parts as the two tables."""
    o = table(spark, sf, "orders").withColumn("date", date_text())
    key = splits.stratified_split(o.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("cls")), "doc_id", "cls").select(F.col("doc_id").alias("o_orderkey"), "split")
    o = o.join(key, "o_orderkey").select(F.col("o_custkey").cast("string").alias("species"), F.col("o_orderpriority").alias("family"), F.col("o_orderstatus").alias("state"), "date", "split")
    p = table(spark, sf, "part").select(F.col("p_brand").alias("species"), F.col("p_type").alias("family"), F.when(F.col("p_partkey") % 2 == 0, F.substring("p_name", 1, 1)).alias("state"), F.lit(None).cast("string").alias("date"), F.lit(" ").alias("split"))
    return curation.statistics({"orders": o, "parts": p}, {"orders": {"species": 30, "family": 20}, "parts": {"species": 30, "family": 20}}, {"state": 36}, "date", {"orders": ["state", "date"], "parts": ["state", "date", "split"]}, "split")


def _top_sql(section, part, rows, k):
    c = f"(SELECT trim({section}) AS value, count(*) AS n FROM {rows} WHERE trim({section}) <> '' GROUP BY 1)"
    r = f"(SELECT *, row_number() OVER (ORDER BY n DESC, value) AS rank FROM {c})"
    return (
        f"SELECT '{section}' AS section, '{part}' AS part, rank, value, n, NULL::DOUBLE AS pct FROM {r} WHERE rank <= {k} "
        f"UNION ALL SELECT '{section}', '{part}', {k + 1}, '(' || count(*) || ' more)', sum(n), NULL FROM {r} WHERE rank > {k} HAVING count(*) > 0 UNION ALL SELECT '{section}', '{part}', count(*), '(total)', coalesce(sum(n), 0), NULL FROM {c}"
    )


def _missing_sql(part, fields):
    one = "SELECT 'missing', '{p}', 0, '{f}', count(*) FILTER ({f} IS NULL OR trim({f}) = ''), round_even(100.0::DOUBLE * count(*) FILTER ({f} IS NULL OR trim({f}) = '') / greatest(count(*), 1), 1) FROM {p}"
    return " UNION ALL ".join(one.format(p=part, f=f) for f in fields)


STATS_SQL = f"""WITH od AS (SELECT *, {DATE_SQL} AS date FROM orders), sp AS ({split_sql('cls', '(SELECT o_orderkey AS doc_id, o_orderpriority AS cls FROM orders)')}),
 a AS (SELECT CAST(o_custkey AS VARCHAR) AS species, o_orderpriority AS family, o_orderstatus AS state, date, split FROM od JOIN sp ON sp.doc_id = o_orderkey),
 b AS (SELECT p_brand AS species, p_type AS family, CASE WHEN p_partkey % 2 = 0 THEN substring(p_name, 1, 1) END AS state, NULL::VARCHAR AS date, ' ' AS split FROM part),
 u AS (SELECT state, date, split FROM a UNION ALL SELECT state, date, split FROM b)
 SELECT section, part, CAST(rank AS BIGINT) AS rank, value, CAST(n AS BIGINT) AS n, pct FROM (
 {" UNION ALL ".join([
    *(_top_sql(c, part, rows, k) for part, rows in (("orders", "a"), ("parts", "b")) for c, k in (("species", 30), ("family", 20))), _top_sql("state", "all", "u", 36),
    *(f"SELECT 'rows', '{part}', 0, '(all)', count(*), NULL FROM {rows}" for part, rows in (("orders", "a"), ("parts", "b"))),
    _missing_sql("a", ["state", "date"]).replace("'a', 0", "'orders', 0"), _missing_sql("b", ["state", "date", "split"]).replace("'b', 0", "'parts', 0"),
    "SELECT 'months', 'all', 0, split_part(date, '/', 2), count(*), NULL FROM u WHERE contains(date, '/') GROUP BY 4",
    "SELECT 'splits', 'all', i, v.s, count(split), round_even(100.0::DOUBLE * count(split) / (SELECT count(*) FROM u WHERE trim(split) <> ''), 1) FROM (VALUES (0, 'train'), (1, 'val'), (2, 'test')) v(i, s) LEFT JOIN u ON u.split = v.s GROUP BY i, v.s",
 ])})"""


def _measures(section, sql, item, names):
    """A table's SQL as section, item, measure, value."""
    return " UNION ALL ".join(f"SELECT '{section}' AS section, {item} AS item, '{n}' AS measure, round(CAST({n} AS DOUBLE), 6) AS value FROM ({sql})" for n in names)


def audited(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey"), date_text().alias("date"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise(F.col("o_orderstatus")).alias("state"))
    return curation.as_measures(curation.audit_tables(o, "o_custkey", "date", ["state", "date"]))


_C = COUNTS_SQL.format(c="o_custkey", t="orders")
_MONTH = "coalesce(try_strptime(date, '%Y/%m/%d'), try_strptime(date, '%Y-%m-%d'))"
AUDIT_SQL = f"""WITH c AS {_C}, d AS (SELECT {DATE_SQL} AS date, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS state FROM orders) {" UNION ALL ".join([
    _measures("summary", "SELECT count(*) AS classes, sum(n) AS rows, avg(n) AS mean, quantile_cont(n, 0.5) AS median, min(n) AS least, (SELECT o_custkey FROM c ORDER BY n, o_custkey LIMIT 1) AS least_class, max(n) AS largest, (SELECT o_custkey FROM c ORDER BY n DESC, o_custkey LIMIT 1) AS largest_class FROM c", "''", ["classes", "rows", "mean", "median", "least", "least_class", "largest", "largest_class"]),
    _measures("thresholds", "SELECT t, count(*) FILTER (n < t) AS classes_below, coalesce(sum(n) FILTER (n < t), 0) AS rows_below, count(*) FILTER (n >= t) AS classes_from, coalesce(sum(n) FILTER (n >= t), 0) AS rows_from, round_even(100.0::DOUBLE * count(*) FILTER (n < t) / count(*), 1) AS pct_below FROM c, (VALUES (10), (20), (30), (50), (100)) v(t) GROUP BY t", "t::VARCHAR", ["classes_below", "rows_below", "classes_from", "rows_from", "pct_below"]),
    _measures("head_tail", "SELECT * FROM (SELECT 'head' AS side, o_custkey, n FROM c ORDER BY n DESC, o_custkey LIMIT 10) UNION ALL SELECT * FROM (SELECT 'tail', o_custkey, n FROM c ORDER BY n, o_custkey LIMIT 10)", "side || ' ' || o_custkey", ["n"]),
    _measures("months", f"SELECT month({_MONTH}) AS m, count(*) AS n, count(*) FILTER ({_MONTH} IS NULL AND date IS NOT NULL) AS invalid FROM d GROUP BY 1", "coalesce(m::VARCHAR, '-')", ["n", "invalid"]),
    *(_measures("missing", f"SELECT count(*) FILTER ({f} IS NULL OR trim({f}) = '') AS missing, count(*) - count(*) FILTER ({f} IS NULL OR trim({f}) = '') AS present, round_even(100.0::DOUBLE * count(*) FILTER ({f} IS NULL OR trim({f}) = '') / count(*), 1) AS pct FROM d", f"'{f}'", ["missing", "present", "pct"]) for f in ("state", "date")),
    _measures("advice", "SELECT *, CASE WHEN under_mid > 30 THEN 'dual head' WHEN under_low > 15 THEN 'consider dual head' ELSE 'single head' END AS advice FROM (SELECT count(*) AS classes, count(*) FILTER (n < 50) AS under_mid, count(*) FILTER (n < 30) AS under_low FROM c)", "advice", ["classes", "under_mid", "under_low"]),
])}"""


def evaluated(spark, sf):
    return curation.as_measures(curation.evaluate(predictions(spark, sf), train_counts(spark, sf), 20))


_STRATA = f"""SELECT coalesce(stratum, 'sparse') AS stratum, target, pred FROM {PRED_SQL} p LEFT JOIN k ON k.label = p.target"""
EVALUATION_SQL = f"""{PER_CLASS_SQL}, k AS (SELECT CASE WHEN count(*) >= 20 THEN 'dense' ELSE 'sparse' END AS stratum, label FROM embeddings WHERE vec_id % 3 <> 0 AND (label <> 7 OR vec_id % 9 = 1) GROUP BY label),
 s AS ({_STRATA}), st AS (SELECT stratum, target AS label, count(*) AS support, count(*) FILTER (target = pred) AS hits FROM s GROUP BY 1, 2), sq AS (SELECT stratum, pred AS label, count(*) AS predicted FROM s GROUP BY 1, 2),
 sj AS (SELECT coalesce(st.stratum, sq.stratum) AS stratum, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, coalesce(hits, 0) AS hits FROM st FULL JOIN sq ON st.label = sq.label AND st.stratum = sq.stratum)
 {" UNION ALL ".join([
    _measures("metrics", "SELECT sum(hits) / sum(support) AS accuracy, avg(prec) AS macro_precision, avg(rec) AS macro_recall, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM c", "''", ["accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1"]),
    _measures("topk", REPORTS["topk_accuracy"][1], "''", ["top1", "top3", "top5"]),
    _measures("strata", "SELECT stratum, (SELECT count(*) FROM k WHERE k.stratum = sj.stratum) AS classes, sum(support) AS samples, sum(hits) / sum(support) AS accuracy, avg(2 * hits / (support + predicted)) AS macro_f1 FROM sj GROUP BY 1", "stratum", ["classes", "samples", "accuracy", "macro_f1"]),
    _measures("confusions", REPORTS["top_confusions"][1], "target || ' ' || pred", ["n"]),
    _measures("errors", f"SELECT target AS label, count(*) AS errors FROM {PRED_SQL} WHERE target <> pred GROUP BY 1 ORDER BY errors DESC, label LIMIT 30", "label::VARCHAR", ["errors"]),
])}"""

QUERIES = {
    "enriched_records": (records, RECORDS_SQL),
    "annotated_boxes": (annotations, ANNOTATIONS_SQL),
    "annotation_errors": (
        annotation_errors,
        """SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'ValueError: unreadable' ELSE 'nothing found' END AS reason, count(*) AS n FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 11 = 0 GROUP BY 1""",
    ),
    "statistics_report": (stats, STATS_SQL),
    "audit_report": (audited, AUDIT_SQL),
    "evaluation_report": (evaluated, EVALUATION_SQL),
}
