"""Leases, breaker and running means over streams whose rows come in any order, with state that ends.

Keys are dealt to ``buckets`` by a hash, which are what Spark keeps state and timers for: a call of a stateful function
costs milliseconds, so one for each key and micro-batch would cost far more than the rows.  Rows wait in their bucket
until the watermark has passed them; an event-time timer then takes them in the order of (key, time, order) and folds
them by key.  A bucket's keys are held by one task at a time: with very many live keys, ask for more buckets (their
number stays with the checkpoint).  So a shuffled stream gives what the batch form gives, as long as rows are not later
than the watermark allows (later ones are left out).  A key whose last row is ``keep`` old loses its state, and begins
anew after such a gap whenever its rows arrive.  The rows after the last watermark wait: a stream that ends needs a
later row of any key to release them.

Runs with the RocksDB state store, which Spark's stateful processors need; ``prepared`` sets it for the session.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.shared import unused

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 256
Step = Callable[[Any, list[tuple], tuple | None], tuple[list[tuple], tuple]]


class Ordered(StatefulProcessor):
    """A fold over each key's rows (key, milliseconds, order, value) by time; see the module.

    A bucket has its waiting rows, one value for each micro-batch that brought some, and the states of its keys with
    the time of their last row.  Both are pickled: keys, orders and values may be of any type.
    """

    def __init__(self, step: Step, out: list[str], keep: int):
        self.step, self.out, self.keep = step, out, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.states = handle.getValueState("states", "states binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        new = [r for f in rows if len(f) for r in zip(_column(f, -6), f.iloc[:, -7].tolist(), _column(f, -4), _column(f, -2), strict=True)]  # by place: Spark does not name them
        if new:
            self.waiting.appendValue((pickle.dumps(new),))
            self.handle.registerTimer(min(r[1] for r in new))
        yield self._table([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        passed = timerValues.getCurrentWatermarkInMs()
        held = [r for (x,) in self.waiting.get() for r in pickle.loads(x)] if self.waiting.exists() else []
        states = pickle.loads(self.states.get()[0]) if self.states.exists() else {}
        ready: dict[Any, list[tuple]] = {}
        late = []
        for r in held:
            if r[1] <= passed:
                ready.setdefault(r[0], []).append(r[1:])
            else:
                late.append(r)
        made: list[tuple] = []
        for k, own in ready.items():
            own.sort(key=lambda r: (r[0], r[1] is not None, r[1], r[2] is not None, r[2]))
            state, last = states.get(k, (None, None))
            for stretch in self._without_gaps(own):
                if last is None or stretch[0][0] - last > self.keep:
                    state = None
                more, state = self.step(k, stretch, state)
                made += more
                last = stretch[-1][0]
            states[k] = (state, last)
        alive = {k: x for k, x in states.items() if x[1] + self.keep >= passed}
        if ready:
            self.waiting.clear()
            if late:
                self.waiting.put([(pickle.dumps(late),)])
                self.handle.registerTimer(min(r[1] for r in late))
        if alive and (ready or len(alive) < len(states)):
            self.states.update((pickle.dumps(alive),))
            self.handle.registerTimer(min(last for _, last in alive.values()) + self.keep + 1)
        elif not alive and states:
            self.states.clear()
        yield self._table(made)

    def _without_gaps(self, rows: list[tuple]) -> Iterator[list[tuple]]:
        """Stretches of rows that follow each other within ``keep``."""
        start = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i][0] - rows[i - 1][0] > self.keep:
                yield rows[start:i]
                start = i

    def _table(self, rows: list[tuple]) -> pd.DataFrame:
        """Columns of objects: whole numbers stay whole beside nulls."""
        columns = zip(*rows, strict=True) if rows else [()] * len(self.out)
        return pd.DataFrame({c: pd.Series(list(x), dtype=object) for c, x in zip(self.out, columns, strict=True)})

    def close(self) -> None:
        """Nothing is held outside the state."""


def _column(frame: pd.DataFrame, place: int) -> list:
    """A column's values; the flags of nulls are in the one after it, for whole numbers beside nulls come as doubles."""
    x, null = frame.iloc[:, place], frame.iloc[:, place + 1]
    none = x.isna().to_numpy() | null.to_numpy(bool)
    values = x.tolist()
    return [None if n else v for n, v in zip(none.tolist(), values, strict=True)] if none.any() else values


def prepared(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark


def _folded(stream: DataFrame, key: str, ts: str, order: str, value: str, late: str, keep: int, step: Step, out: str, buckets: int) -> DataFrame:
    prepared(stream.sparkSession)
    kinds = dict(stream.dtypes)
    named = []
    for c, name in ((key, "_key"), (order, "_order"), (value, "_value")):
        whole = kinds[c] in ("tinyint", "smallint", "int", "bigint")
        named += [(F.coalesce(F.col(c), F.lit(0).cast(kinds[c])) if whole else F.col(c)).alias(name), F.col(c).isNull().alias(f"{name}_null")]
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("_bucket")
    rows = stream.withWatermark(ts, late).filter(F.col(ts).isNotNull()).select(bucket, F.col(ts), F.unix_millis(ts).alias("_ms"), *named)
    names = [x.strip().split()[0] for x in out.split(",")]
    return rows.groupBy("_bucket").transformWithStateInPandas(Ordered(step, names, keep), outputStructType=out, outputMode="Append", timeMode="EventTime")


def lease_grants(stream: DataFrame, key: str, ts: str, ttl: int = 600, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """(key, granted): a claim is granted if the last grant is ttl seconds old.  A lease's state ends with it."""

    def step(k: Any, rows: list[tuple], state: tuple | None) -> tuple[list[tuple], tuple]:
        at, out = (state[0] if state else None), []
        for ms, _, _ in rows:
            if at is None or ms // 1000 - at >= ttl:
                at = ms // 1000
                out.append((k, at))
        return out, (at,)

    kind = dict(stream.dtypes)[key]
    at = unused(stream.columns, "_at")
    stream = stream.withColumn(at, F.unix_millis(ts))
    return _folded(stream, key, ts, at, at, late, (ttl + 1) * 1000, step, f"{key} {kind}, granted long", buckets)


def circuit_breaker(stream: DataFrame, key: str, ts: str, order: str, ok: str, run: int = 10, stop: int = 3, late: str = "1 hour", keep: int = 86_400, buckets: int = BUCKETS) -> DataFrame:
    """(key, order, trip) of the attempts that are reached; a key that is silent for ``keep`` seconds begins anew."""

    def step(k: Any, rows: list[tuple], state: tuple | None) -> tuple[list[tuple], tuple]:
        streak, trips = state or (0, 0)
        out = []
        for _, o, good in rows:
            if trips >= stop:
                break
            streak = 0 if good else streak + 1
            trip = not good and streak % run == 0
            trips += trip
            out.append((k, o, trip))
        return out, (streak, trips)

    kinds = dict(stream.dtypes)
    return _folded(stream, key, ts, order, ok, late, keep * 1000, step, f"{key} {kinds[key]}, {order} {kinds[order]}, trip boolean", buckets)


def ema(stream: DataFrame, key: str, ts: str, order: str, value: str, mean: float = 0.9, late: str = "1 hour", keep: int = 86_400, buckets: int = BUCKETS) -> DataFrame:
    """(key, n, ema) whenever rows of a key are released; see operators.workplan.ema."""

    def step(k: Any, rows: list[tuple], state: tuple | None) -> tuple[list[tuple], tuple]:
        n, x = state or (0, None)
        for _, _, v in rows:
            n += 1
            if v is not None:
                x = float(v) if x is None else mean * x + (1 - mean) * float(v)
        return [(k, n, x)], (n, x)

    return _folded(stream, key, ts, order, value, late, keep * 1000, step, f"{key} {dict(stream.dtypes)[key]}, n long, ema double", buckets)
