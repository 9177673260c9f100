"""Planning of incremental work: chunks, batches, leases, failure streaks, running metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import runs
from tessera.operators.tables import in_parts, numbered
from tessera.shared import unused


def chunks(df: DataFrame, order: list[str], k: int, mode: str = "contiguous") -> DataFrame:
    """Rows with their chunk: 'contiguous' (pieces of ceil(n/k)), 'plus_one' (of floor(n/k)+1) or 'round_robin'; from 0."""
    rows = numbered(df, order, "_i", 0)
    if mode == "round_robin":
        return rows.withColumn("chunk", F.pmod(F.col("_i"), F.lit(k))).drop("_i")
    total = df.agg(F.count("*").alias("_n"))
    size = F.ceil(F.col("_n") / k) if mode == "contiguous" else F.floor(F.col("_n") / k) + 1
    return rows.crossJoin(F.broadcast(total)).withColumn("chunk", F.floor(F.col("_i") / size).cast("long")).drop("_i", "_n")


def batch_by_count(df: DataFrame, order: list[str], size: int) -> DataFrame:
    return numbered(df, order, "_i", 0).withColumn("batch", F.floor(F.col("_i") / size).cast("long")).drop("_i")


def batch_by_bytes(df: DataFrame, group: str, order: str, size: str, limit: int, header: int = 0) -> DataFrame:
    """Greedy batches of a group's rows in order: one opens when the next row would pass the limit; an oversized row
    goes alone. group, order, size, batch. A null size counts as 0, as does a negative one in what a batch holds.

    The next batch's first row is found by binary search on sums of sizes; see runs.chained for groups of any size.
    """
    part, pos = "part", "pos"
    names = {group: "_group", order: "_order", size: "_size"}
    rows = df.select(F.col(group).alias("_group"), F.col(order).alias("_order"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("_size"))
    rows = in_parts(rows, ["_group", "_order", "_size"], part, pos).withColumn("size", F.greatest("_size", F.lit(0))).withColumn("at", F.lit(0).cast("long"))
    rows = rows.select("_group", part, pos, "at", "size", "_order", "_size")

    def made(table: pa.Table, base: int) -> runs.Segment:
        held = table.column("size").to_numpy()
        upto = base + np.cumsum(held)
        return runs.Segment(upto, upto - held + limit - header + 1)

    def out(table: pa.Table, start: np.ndarray, so_far: np.ndarray) -> list:
        return [table.column("_group"), table.column("_order"), table.column("_size"), pa.array(so_far - 1)]

    fields = [*(T.StructField(n, rows.schema[n].dataType) for n in ("_group", "_order", "_size")), T.StructField("batch", T.LongType())]
    got = runs.chained(rows, "_group", made, out, T.StructType(fields), size=True)
    return got.select(*(F.col(own).alias(name) for name, own in names.items()), "batch")


def circuit_breaker(log: DataFrame, key: str, order: str, ok: str, run: int = 10, stop: int = 3) -> DataFrame:
    """Attempts that are reached, with ``trip``: every run-th failure in a row trips; nothing follows the stop-th trip.

    A key's log may lie in several parts: streaks and trips are carried over them (runs.breaker).
    """
    return runs.breaker(log, key, order, ok, run, stop)


def lease_grants(log: DataFrame, key: str, seconds: str, ttl: int = 600) -> DataFrame:
    """(key, granted at): a claim is granted if the last grant is ttl seconds old; claims without a time are none.

    The next grant is found by binary search on times; see runs.chained for keys of any size.  ttl is above 0.
    """
    times = log.select(F.col(key).alias("_key"), F.col(seconds).cast("bigint").alias("at")).filter("at is not null")
    rows = in_parts(times, ["_key", "at"], "part", "pos").select("_key", "part", "pos", "at")

    def made(table: pa.Table, base: int) -> runs.Segment:
        at = table.column("at").to_numpy()
        return runs.Segment(at, at + ttl)

    def out(table: pa.Table, start: np.ndarray, so_far: np.ndarray) -> list:
        return [table.column("_key").filter(pa.array(start)), table.column("at").filter(pa.array(start))]

    schema = T.StructType([T.StructField("_key", rows.schema["_key"].dataType), T.StructField("granted", T.LongType())])
    return runs.chained(rows, "_key", made, out, schema, size=False).select(F.col("_key").alias(key), "granted")


def ema(df: DataFrame, key: str, order: str, value: str, keep: float = 0.9) -> DataFrame:
    """(key, n, ema) after all values in order; the first value seeds, null values are counted but leave it.

    Each segment of a run is an affine map of the mean before it; the maps of a key compose in order (runs.ema).
    """
    return runs.ema(df, key, order, value, keep)


def best_so_far(df: DataFrame, order: str, value: str, key: str | None = None) -> DataFrame:
    """Rows whose value is above all before it (and above 0 for the first).

    Rows are sorted over range partitions; each starts from the largest value of the partitions before it (of its
    key), so neither a table without key nor a hot key is one task.
    """
    part, pos, top, none = (unused(df.columns, x) for x in ("_part", "_pos", "_top", "_key"))
    own = key or none
    rows = df if key else df.withColumn(none, F.lit(0))
    rows = in_parts(rows, [own, order], part, pos)
    w = Window.partitionBy(own).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row per partition and key
    tops = rows.groupBy(own, part).agg(F.max(value).alias(top)).select(F.col(own).alias(own + top), F.col(part).alias(part + top), F.max(top).over(w).alias(top))
    got = rows.join(tops, (rows[part] == tops[part + top]) & rows[own].eqNullSafe(tops[own + top]))
    before = F.max(value).over(Window.partitionBy(own, part).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1))
    got = got.withColumn(pos, F.coalesce(F.greatest(before, top), F.lit(0.0)))
    return got.filter(F.col(value) > F.col(pos)).select(*df.columns)


def run_counters(log: DataFrame, planned: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """One row: planned keys, those already done, remaining, and the attempts that went well and did not."""
    p = planned.select(key).distinct().join(done.select(key).distinct().withColumn("_d", F.lit(1)), key, "left").agg(F.count("*").alias("planned"), F.count("_d").alias("done"))
    a = log.agg(F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failed"))
    return p.crossJoin(a).withColumn("remaining", F.col("planned") - F.col("done"))
