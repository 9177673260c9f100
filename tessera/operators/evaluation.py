"""Scores of predictions, by class, stratum and confusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbers import top_indices


def confusion(df: DataFrame) -> DataFrame:
    """(target, pred, n), only pairs that occur."""
    return df.groupBy("target", "pred").agg(F.count("*").alias("n"))


def per_class(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(label, support, predicted, hits, precision, recall, f1) over the labels that occur as target or prediction."""
    by, hit = by or [], F.count_if(F.col("target") == F.col("pred"))
    t = df.groupBy(*by, F.col("target").alias("label")).agg(F.count("*").alias("support"), hit.alias("hits"))
    p = df.groupBy(*by, F.col("pred").alias("label")).agg(F.count("*").alias("predicted"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    j = t.join(p, [*by, "label"], "full_outer").select(*by, "label", *(zero(F.col(c)).alias(c) for c in ("support", "predicted", "hits")))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return j.select("*", ratio(F.col("hits"), F.col("predicted")).alias("precision"), ratio(F.col("hits"), F.col("support")).alias("recall"), ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"))


def metrics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, macro precision, recall and F1 and F1 weighted by support; a score without any case is 0."""
    c = per_class(df, by)
    return c.groupBy(*(by or [])).agg(
        F.coalesce(F.try_divide(F.sum("hits"), F.sum("support")), F.lit(0.0)).alias("accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"), F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), F.lit(0.0)).alias("weighted_f1"),
    )


def topk_accuracy(df: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row with top<k>: how often the target is among the k largest logits."""
    top = df.select("target", top_indices(F.col("logits"), max(ks)).alias("_t"))
    return top.agg(*(F.avg(F.array_contains(F.slice("_t", 1, k), F.col("target")).cast("double")).alias(f"top{k}") for k in ks))


def strata(df: DataFrame, train_counts: DataFrame, threshold: int) -> DataFrame:
    """Scores of targets in classes with many and with few training rows: stratum, classes, samples, accuracy, macro_f1.

    train_counts: (label, n), joined by label; classes are counted over all of them, F1 over the stratum's rows. A
    stratum without rows is left out; a class unknown in training is sparse.
    """
    kind = F.when(F.col("n") >= threshold, "dense").otherwise("sparse")
    counts = train_counts.select("label", kind.alias("stratum"))
    rows = df.join(counts, df.target == counts.label, "left").withColumn("stratum", F.coalesce("stratum", F.lit("sparse")))
    m = metrics(rows.select("stratum", "target", "pred"), ["stratum"]).select("stratum", "accuracy", "macro_f1")
    n = rows.groupBy("stratum").agg(F.count("*").alias("samples"))
    k = counts.groupBy("stratum").agg(F.count("*").alias("classes"))
    return n.join(m, "stratum").join(k, "stratum", "left").select("stratum", F.coalesce("classes", F.lit(0)).alias("classes"), "samples", "accuracy", "macro_f1")


def top_confusions(df: DataFrame, k: int = 20) -> DataFrame:
    """The k commonest wrong pairs, by count, target and prediction downwards."""
    return confusion(df.filter("target <> pred")).orderBy(F.desc("n"), F.desc("target"), F.desc("pred")).limit(k)


def error_classes(df: DataFrame, k: int = 30) -> DataFrame:
    """The k classes with most errors (ties by label): label, errors."""
    return df.filter("target <> pred").groupBy(F.col("target").alias("label")).agg(F.count("*").alias("errors")).orderBy(F.desc("errors"), "label").limit(k)


def error_submatrix(df: DataFrame, k: int = 30) -> DataFrame:
    """Confusions whose both sides are among the classes with most errors."""
    few = F.broadcast(error_classes(df, k).select("label"))  # k rows
    c = confusion(df)
    return c.join(few, c.target == few.label, "left_semi").join(few, c.pred == few.label, "left_semi")
