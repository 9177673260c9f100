"""Plans that chain operators: curation, enrichment, the statistics report, the audit and the evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbers import percent
from tessera.functions.text import clean_text
from tessera.operators import audit, evaluation
from tessera.operators.splits import stratified_split
from tessera.operators.tables import assembled, keep_last, lookup_ordered, numbered
from tessera.shared import shared_dir, written


def split_report(docs: DataFrame) -> DataFrame:
    """Clean texts, keep the last row of each text, split by language; rows and percentage per (lang, split)."""
    rows = docs.select("doc_id", "lang", F.md5(clean_text(F.col("text"))).alias("k"))
    one = keep_last(rows, "k", "doc_id").select("doc_id", "lang")
    counts = stratified_split(one, "doc_id", "lang").groupBy("lang", "split").agg(F.count("*").alias("n"))
    whole = counts.groupBy("lang").agg(F.sum("n").alias("_t"))  # a row per language
    return counts.join(F.broadcast(whole), "lang").select("lang", "split", "n", percent(F.col("n"), F.col("_t")).alias("pct"))


def enrich(files: DataFrame, id_col: str, keys: Sequence[Column], known: DataFrame, known_key: str, fields: dict, order: Sequence[str], first: int = 1) -> DataFrame:
    """Records of files: look-up by candidate keys, per-field fallback to what was parsed, then constants, and ids.

    fields: name -> (column of ``known``, column of ``files``, constant), any of them None.
    """
    rows = lookup_ordered(files, keys, known, known_key, id_col)
    picks = {n: (k and F.col(k), p and F.col(p), c) for n, (k, p, c) in fields.items()}
    return numbered(assembled(rows, F.col(known_key).isNotNull(), picks, [id_col]), order, "image_id", first)


def statistics(tables: dict[str, DataFrame], tops: dict[str, dict[str, int]], shared: dict[str, int], date: str, missing: dict[str, Sequence[str]], split: str) -> DataFrame:
    """The statistics report as one frame: section, part, rank, value, n, pct.

    tops: per table, columns with how many of the commonest values are listed; shared: the same over all tables;
    months of all tables by text; missing fields of each table (value is the field, n the rows without it); splits
    of all tables. A '(k more)' row closes a cut list, and '(total)' gives the rows and, as rank, the different values.
    All columns of a table are counted in one scan; the counts are stored and every section is made of them.
    """
    spark = next(iter(tables.values())).sparkSession
    none, parts = F.lit(None).cast("double"), []

    def add(section: str, part: str, rows: DataFrame, rank: Column, value: Column, n: Column, pct: Column = none) -> None:
        parts.append(rows.select(F.lit(section).alias("section"), F.lit(part).alias("part"), rank.cast("long").alias("rank"), value.cast("string").alias("value"), n.cast("long").alias("n"), pct.alias("pct")))

    def top(section: str, part: str, counts: DataFrame, k: int) -> None:
        add(section, part, audit.top_with_tail(counts, "value", k), F.col("rank"), F.col("value"), F.col("n"))
        add(section, part, counts.agg(F.count("*").alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")), F.col("c"), F.lit("(total)"), F.col("n"))

    each = [audit.distributions(t, sorted({*tops[name], *shared, split})).withColumn("table", F.lit(name)) for name, t in tables.items()]
    kept = written(reduce(DataFrame.unionByName, each), shared_dir(spark, "statistics"))
    of_table = lambda col, name: kept.filter((F.col("field") == col) & (F.col("table") == name)).select("value", "n")
    of_all = lambda col: kept.filter(F.col("field") == col).groupBy("value").agg(F.sum("n").alias("n"))
    dates = reduce(DataFrame.unionByName, (t.select(F.col(date).cast("string").alias(date)) for t in tables.values()))
    for name, rows in tables.items():
        add("rows", name, rows.agg(F.count("*").alias("n")), F.lit(0), F.lit("(all)"), F.col("n"))
        for col, k in tops[name].items():
            top(col, name, of_table(col, name), k)
        lack = audit.missing_fields(rows, missing[name])
        add("missing", name, lack, F.lit(0), F.col("field"), F.col("missing"), F.col("pct"))
    for col, k in shared.items():
        top(col, "all", of_all(col), k)
    add("months", "all", audit.months_as_text(dates, date), F.lit(0), F.col("month"), F.col("n"))
    counts = of_all(split).select(F.col("value").alias("split"), "n")
    add("splits", "all", audit.in_fixed_order(counts, "split", ["train", "val", "test"]), F.col("position"), F.col("split"), F.col("n"), F.col("pct"))
    return reduce(DataFrame.unionByName, parts)


def audit_tables(rows: DataFrame, cls: str, date: str, fields: list[str]) -> dict[str, DataFrame]:
    """The audit's tables by name."""
    counts = rows.filter(F.col(cls).isNotNull()).groupBy(cls).agg(F.count("*").alias("n"))
    return {
        "summary": audit.class_summary(counts, cls), "thresholds": audit.threshold_table(counts), "head_tail": audit.head_and_tail(counts, cls),
        "months": audit.months_checked(rows, date), "missing": audit.missing_fields(rows, fields), "advice": audit.recommendation(counts),
    }


def evaluate(predictions: DataFrame, train_counts: DataFrame, threshold: int = 30) -> dict[str, DataFrame]:
    """Headline scores, strata and confusions of predictions (target, pred, logits)."""
    return {
        "metrics": evaluation.metrics(predictions), "topk": evaluation.topk_accuracy(predictions), "strata": evaluation.strata(predictions, train_counts, threshold),
        "confusions": evaluation.top_confusions(predictions), "errors": evaluation.error_classes(predictions),
    }


#: Columns that name a row of the audit's and the evaluation's tables; all other numbers are measures.
ITEMS = {"thresholds": ["threshold"], "head_tail": ["side", "value"], "months": ["month"], "missing": ["field"], "advice": ["advice"], "strata": ["stratum"], "confusions": ["target", "pred"], "errors": ["label"]}


def as_measures(tables: dict[str, DataFrame], digits: int = 6) -> DataFrame:
    """Several small tables as one: section, item, measure, value (double, rounded)."""
    parts = []
    for section, df in tables.items():
        names = ITEMS.get(section, [])
        measures = [c for c, t in df.dtypes if c not in names and t in ("int", "bigint", "double")]
        item = F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in names)) if names else F.lit("")
        pairs = F.array(*(F.struct(F.lit(c).alias("measure"), F.round(F.col(c).cast("double"), digits).alias("value")) for c in measures))
        parts.append(df.select(F.lit(section).alias("section"), item.alias("item"), F.inline(pairs)))
    return reduce(DataFrame.unionByName, parts)
