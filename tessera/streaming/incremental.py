"""Structured Streaming forms of the incremental operators; each equals its batch form on replay."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.streaming.manifest import Manifest


def process_new(stream: DataFrame, process, output: str, manifest: str, key: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Process rows whose key the manifest lacks; output and manifest are appended, each micro-batch once.

    Of a batch's rows with one key the same one is taken in every run.  A batch that is repeated after a failure finds
    its own keys under its label and processes them again; its folders are overwritten, so nothing is doubled.  What
    a batch reads of the manifest follows its own keys (streaming.manifest).
    """

    def batch(df: DataFrame, number: int) -> None:
        label = f"{zlib.crc32(checkpoint.encode()):08x}-{number}"
        ledger = Manifest(df.sparkSession, manifest, key, dict(df.dtypes)[key], buckets)
        rest = [c for c in df.columns if c != key]
        one = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.to_json(F.struct(*rest))).alias("_r")) if rest else df.distinct()
        fresh = ledger.new(one.select(*(F.col(c if c == key else f"_r.{c}").alias(c) for c in df.columns)), label).persist()
        try:
            process(fresh).write.mode("overwrite").parquet(f"{output}/batch={label}")
            ledger.add(fresh, label)
        finally:
            fresh.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(stream: DataFrame, *by: str) -> DataFrame:
    """Running counts by group; write with complete mode, e.g. every 10 seconds."""
    return stream.groupBy(*by).agg(F.count("*").alias("n"))


def _stateful(stream: DataFrame, key: str, output: str, state: str, step) -> DataFrame:
    """Rows of a key in order through ``step(rows, state) -> (rows, state)`` with the state kept between batches."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        out, new = step(k[0], rows, group.get if group.exists else None)
        group.update(new)
        yield out

    return stream.groupBy(key).applyInPandasWithState(run, output, state, "append", GroupStateTimeout.NoTimeout)


def lease_grants(stream: DataFrame, key: str, seconds: str, ttl: int = 600) -> DataFrame:
    """(key, granted): a claim is granted if the key's last grant is ttl seconds old. Claims of a key arrive in order."""

    def step(k: Any, rows: pd.DataFrame, last: tuple | None) -> tuple[pd.DataFrame, tuple]:
        at, granted = (last[0] if last else None), []
        for t in sorted(rows[seconds].tolist()):
            if at is None or t - at >= ttl:
                at = t
                granted.append(t)
        return pd.DataFrame({key: [k] * len(granted), "granted": granted}), (at,)

    return _stateful(stream, key, f"{key} {dict(stream.dtypes)[key]}, granted long", "at long", step)


def circuit_breaker(stream: DataFrame, key: str, order: str, ok: str, run: int = 10, stop: int = 3) -> DataFrame:
    """(key, order, trip) of the attempts that are reached; see operators.workplan.circuit_breaker."""

    def step(k: Any, rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        length, trips = state or (0, 0)
        out = []
        for o, good in sorted(zip(rows[order].tolist(), rows[ok].tolist(), strict=True)):
            if trips >= stop:
                break
            length = 0 if good else length + 1
            trip = not good and length % run == 0
            trips += trip
            out.append((k, o, trip))
        return pd.DataFrame(out, columns=[key, order, "trip"]), (length, trips)

    kinds = dict(stream.dtypes)
    return _stateful(stream, key, f"{key} {kinds[key]}, {order} {kinds[order]}, trip boolean", "length long, trips long", step)


def ema(stream: DataFrame, key: str, order: str, value: str, keep: float = 0.9) -> DataFrame:
    """(key, n, ema) after each micro-batch of a key's values in order."""

    def step(k: Any, rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        n, mean = state or (0, None)
        for _, v in sorted(zip(rows[order].tolist(), rows[value].tolist(), strict=True)):
            n, mean = n + 1, v if mean is None else keep * mean + (1 - keep) * v
        return pd.DataFrame({key: [k], "n": [n], "ema": [mean]}), (n, mean)

    return _stateful(stream, key, f"{key} {dict(stream.dtypes)[key]}, n long, ema double", "n long, mean double", step)


def tumbling(stream: DataFrame, ts: str, width: str = "1 hour", late: str = "2 hours", *by: str) -> DataFrame:
    """Counts in fixed windows; rows later than the watermark are left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("window"), *by).agg(F.count("*").alias("n"))


def sliding(stream: DataFrame, ts: str, width: str = "1 hour", step: str = "15 minutes", late: str = "2 hours", *by: str) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width, step).alias("window"), *by).agg(F.count("*").alias("n"))


def session_counts(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("window")).agg(F.count("*").alias("n"))
