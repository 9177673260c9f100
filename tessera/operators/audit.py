"""Counts and distribution reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numbers import month_of, month_text, percent


def distribution(df: DataFrame, col: str) -> DataFrame:
    """(value, n) of trimmed non-blank values."""
    v = F.trim(F.col(col).cast("string"))
    return df.select(v.alias("value")).filter("value <> ''").groupBy("value").agg(F.count("*").alias("n"))


def distributions(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(field, value, n) of several columns in one scan."""
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.trim(F.col(c).cast("string")).alias("value")) for c in cols))
    return df.select(F.inline(pairs)).filter("value <> ''").groupBy("field", "value").agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Counts with the percentage of all rows, nulls included in the whole."""
    total = df.agg(F.count("*").alias("_t"))
    return df.groupBy(*cols).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).withColumn("pct", percent(F.col("n"), F.col("_t"))).drop("_t")


def missing_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, missing, present, pct missing) for null or blank; an empty table counts as one row in the percentage."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
    one = df.agg(F.count("*").alias("_t"), *(F.count_if(blank(c)).alias(c) for c in fields))
    rows = one.select("_t", F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("missing")) for c in fields))))
    return rows.select("field", "missing", (F.col("_t") - F.col("missing")).alias("present"), percent(F.col("missing"), F.greatest("_t", F.lit(1))).alias("pct"))


def class_summary(counts: DataFrame, cls: str, n: str = "n") -> DataFrame:
    """One row over class counts: classes, rows, mean, median, least and largest with their class (the first of equals)."""
    key = lambda sign: F.struct((F.col(n) * sign).alias("n"), F.col(cls).alias("c"))
    return counts.agg(
        F.count("*").alias("classes"), F.sum(n).alias("rows"), F.avg(n).alias("mean"), F.percentile(n, F.lit(0.5)).alias("median"),
        F.min(n).alias("least"), F.min(key(1))["c"].alias("least_class"), F.max(n).alias("largest"), F.min(key(-1))["c"].alias("largest_class"),
    )


def threshold_table(counts: DataFrame, thresholds: Sequence[int] = (10, 20, 30, 50, 100), n: str = "n") -> DataFrame:
    """Per threshold: classes and rows below it and at or above it, with the percentage of classes below."""
    rows = counts.select(F.col(n).alias("n"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    below = F.col("n") < F.col("threshold")
    out = rows.groupBy("threshold").agg(
        F.count_if(below).alias("classes_below"), F.coalesce(F.sum(F.when(below, F.col("n"))), F.lit(0)).alias("rows_below"), F.count_if(~below).alias("classes_from"),
        F.coalesce(F.sum(F.when(~below, F.col("n"))), F.lit(0)).alias("rows_from"),
    )
    return out.withColumn("pct_below", percent(F.col("classes_below"), F.col("classes_below") + F.col("classes_from")))


def months_as_text(df: DataFrame, date: str) -> DataFrame:
    """(month, n) by the second part of dates with slashes, as it stands."""
    return df.select(month_text(F.col(date)).alias("month")).filter("month is not null").groupBy("month").agg(F.count("*").alias("n"))


def months_checked(df: DataFrame, date: str) -> DataFrame:
    """(month, n) of real dates; month null has the rows without one, of which ``invalid`` had a text."""
    m = df.select(month_of(F.col(date)).alias("month"), F.coalesce(F.trim(F.col(date)) != "", F.lit(False)).alias("_text"))
    return m.groupBy("month").agg(F.count("*").alias("n"), F.count_if(F.col("month").isNull() & F.col("_text")).alias("invalid"))


def in_fixed_order(counts: DataFrame, col: str, values: Sequence[str], n: str = "n") -> DataFrame:
    """The given values in their order with zero fill and percentages: position, value, n, pct (of all counted)."""
    fixed = counts.sparkSession.createDataFrame([(i, v) for i, v in enumerate(values)], f"position int, {col} string")
    total = counts.agg(F.sum(n).alias("_t"))
    out = F.broadcast(fixed).join(counts, col, "left").crossJoin(F.broadcast(total))
    return out.select("position", col, F.coalesce(F.col(n), F.lit(0)).alias("n"), percent(F.coalesce(F.col(n), F.lit(0)), F.col("_t")).alias("pct"))


def top_with_tail(counts: DataFrame, value: str, k: int, n: str = "n") -> DataFrame:
    """The k commonest (ties by value) as rank, value, n, and a last row with what is left: '(k more)' classes and their rows."""
    top = counts.orderBy(F.desc(n), value).limit(k)
    total = counts.agg(F.count("*").alias("c"), F.sum(n).alias("r"))
    head = top.agg(F.count("*").alias("hc"), F.coalesce(F.sum(n), F.lit(0)).alias("hr"))
    rows = top.select(F.row_number().over(Window.orderBy(F.desc(n), value)).alias("rank"), F.col(value).alias("value"), F.col(n).alias("n"))  # k rows
    tail = total.crossJoin(head).filter("c > hc").select(F.lit(k + 1).alias("rank"), F.concat(F.lit("("), F.col("c") - F.col("hc"), F.lit(" more)")).alias("value"), (F.col("r") - F.col("hr")).alias("n"))
    return rows.unionByName(tail)


def head_and_tail(counts: DataFrame, value: str, k: int = 10, n: str = "n") -> DataFrame:
    """The k classes with most and with least rows (ties by value): side, value, n."""
    pick = lambda side, *order: counts.orderBy(*order).limit(k).select(F.lit(side).alias("side"), F.col(value).alias("value"), F.col(n).alias("n"))
    return pick("head", F.desc(n), F.asc(value)).unionByName(pick("tail", F.asc(n), F.asc(value)))


def coverage(df: DataFrame, cls: str, split: str) -> DataFrame:
    """Distinct classes and rows per split."""
    return df.groupBy(split).agg(F.countDistinct(cls).alias("classes"), F.count("*").alias("n"))


def missing_pairs(df: DataFrame, cls: str, split: str, values: Sequence[str], examples: int = 5) -> DataFrame:
    """Per split value: how many classes it lacks, and the first few of them by name."""
    classes = df.select(cls).distinct()
    pairs = classes.withColumn(split, F.explode(F.array(*map(F.lit, values))))  # a few fixed values
    gone = pairs.join(df.select(cls, split).distinct(), [cls, split], "left_anti")
    rank = F.row_number().over(Window.partitionBy(split).orderBy(cls))
    few = F.array_join(F.array_sort(F.collect_list(F.when(F.col("_r") <= examples, F.col(cls)))), ",")
    return gone.withColumn("_r", rank).groupBy(split).agg(F.count("*").alias("missing"), few.alias("examples"))


def folder_mismatch(files: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Keys whose numbers of files and of rows differ: key, files, rows."""
    a, b = files.groupBy(key).agg(F.count("*").alias("files")), rows.groupBy(key).agg(F.count("*").alias("rows"))
    out = a.join(b, key, "full_outer").select(key, F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("rows", F.lit(0)).alias("rows"))
    return out.filter("files <> rows")


def stage_dashboard(stages: dict[str, DataFrame], group: str) -> DataFrame:
    """Per group the rows of each stage, and each later stage's percentage of the first (0 without any)."""
    names = list(stages)
    parts = [d.select(F.col(group), F.lit(s).alias("stage")) for s, d in stages.items()]
    wide = reduce(DataFrame.unionByName, parts).groupBy(group).agg(*(F.count_if(F.col("stage") == s).alias(s) for s in names))
    return wide.select("*", *(percent(F.col(s), F.col(names[0])).alias(f"{s}_pct") for s in names[1:]))


def folder_pending(raw: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Keys with fewer done than raw rows, or none done: key, raw, done."""
    a, b = raw.groupBy(key).agg(F.count("*").alias("raw")), done.groupBy(key).agg(F.count("*").alias("done"))
    return a.join(b, key, "left").select(key, "raw", F.coalesce("done", F.lit(0)).alias("done")).filter("done < raw")


def status_totals(df: DataFrame, key: str, status: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(key).agg(*(F.count_if(F.col(status) == v).alias(v) for v in values))


def recommendation(counts: DataFrame, n: str = "n", low: int = 30, mid: int = 50, many: int = 30, some: int = 15) -> DataFrame:
    """One row: classes below two thresholds and the advice that follows."""
    out = counts.agg(F.count("*").alias("classes"), F.count_if(F.col(n) < mid).alias("under_mid"), F.count_if(F.col(n) < low).alias("under_low"))
    return out.withColumn("advice", F.when(F.col("under_mid") > many, "dual head").when(F.col("under_low") > some, "consider dual head").otherwise("single head"))


def sync_totals(local: DataFrame, remote: DataFrame, key: str, batch: int, examples: int = 10) -> DataFrame:
    """One row: local, remote and missing keys, the first few missing, and the batches these need."""
    a, b = local.select(key).distinct(), remote.select(key).distinct()
    gone = a.join(b, key, "left_anti")
    few = gone.orderBy(key).limit(examples).agg(F.array_join(F.array_sort(F.collect_list(key)), ",").alias("first_missing"))
    count = lambda d, name: d.agg(F.count("*").alias(name))
    return count(a, "n_local").crossJoin(count(b, "n_remote")).crossJoin(count(gone, "n_missing")).crossJoin(few).withColumn("batches", F.ceil(F.col("n_missing") / batch).cast("long"))


def mean_or_zero(total: Column, n: Column) -> Column:
    """A mean whose number is at least 1, so that nothing summed over nothing is 0."""
    return F.coalesce(total, F.lit(0.0)) / F.greatest(n, F.lit(1))
