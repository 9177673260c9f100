"""Folds over a key's ordered rows in which a key may be larger than a task.

Rows are sorted by (key, order) over range partitions and stored.  What a key has in one part is a segment; a part
boundary cuts one key at most, so the segments of keys that have several number twice the parts at most.  A fold is
then a summary of each segment, a carry over the segments of a key, and a second pass in which each segment knows
the state that it begins in:

- running means are affine maps of the state, which compose (``ema``);
- failure streaks are finite-state transitions that sums over segments carry (``breaker``);
- greedy chains (leases, batches of bytes) go from a start to the next one by binary search; within a segment all
  ways are followed at once by pointer doubling, and between segments by doubling on where they lead out (``chained``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.operators.tables import in_parts
from tessera.shared import shared_dir, unused, written

BEGIN = np.iinfo(np.int64).min


def _changes(*columns: pa.Array) -> np.ndarray:
    """Where a row differs from the one before it in any column; nulls are alike."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    out[:1] = True
    for c in columns:
        a, b = c.slice(1), c.slice(0, max(n - 1, 0))
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        out[1:] |= differ | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return out


# running means


def _affine(batch: pa.RecordBatch, keep: float) -> list[pa.Array]:
    """key, part, pos, n, m, a, b, s of each segment's share of a batch: m values take x to a x + b, and no state to s."""
    key, part, pos, value = batch.columns
    starts = np.flatnonzero(_changes(key, part))
    run = np.zeros(len(key), np.int64)
    run[starts[1:]] = 1
    run = np.cumsum(run)
    v, valid = value.to_numpy(zero_copy_only=False), value.is_valid().to_numpy(zero_copy_only=False)
    seen = np.cumsum(valid)
    m = np.bincount(run, valid, len(starts)).astype(np.int64)
    rank = seen - (seen[starts] - valid[starts])[run]
    weight = keep ** (m[run] - rank).astype(float)
    b = np.bincount(run, np.where(valid, (1 - keep) * weight * np.where(valid, v, 0.0), 0.0), len(starts))
    first = np.bincount(run, np.where(valid & (rank == 1), np.where(valid, v, 0.0), 0.0), len(starts))
    a = keep ** m.astype(float)
    at = pa.array(starts)
    return [key.take(at), part.take(at), pos.take(at), *map(pa.array, (np.bincount(run, minlength=len(starts)), m, a, b, b + a * first))]


def ema(df: DataFrame, key: str, order: str, value: str, keep: float) -> DataFrame:
    """(key, n, ema): see workplan.ema."""
    part, pos = (unused([key, order], x) for x in ("part", "pos"))
    rows = in_parts(df.select(key, order, F.col(value).cast("double").alias("ema")), [key, order, "ema"], part, pos).select(key, part, pos, "ema")
    names = [key, "part", "pos", "n", "m", "a", "b", "s"]
    schema = T.StructType([df.schema[key], *T.StructType.fromDDL("part long, pos long, n long, m long, a double, b double, s double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays(_affine(batch, keep), names)

    def composed(x: Column, y: Column) -> Column:
        s = F.when(x["m"] == 0, y["s"]).when(y["m"] == 0, x["s"]).otherwise(y["a"] * x["s"] + y["b"])
        return F.struct((x["n"] + y["n"]).alias("n"), (x["m"] + y["m"]).alias("m"), (x["a"] * y["a"]).alias("a"), (y["a"] * x["b"] + y["b"]).alias("b"), s.alias("s"))

    none = F.struct(*(F.lit(v).cast(k).alias(c) for c, v, k in (("n", 0, "long"), ("m", 0, "long"), ("a", 1.0, "double"), ("b", 0.0, "double"), ("s", 0.0, "double"))))
    maps = rows.mapInArrow(run, schema)
    for by, at in ([key, "part"], "pos"), ([key], "part"):  # the shares of a segment, then the segments of a key
        listed = F.array_sort(F.collect_list(F.struct(at, "n", "m", "a", "b", "s")))
        maps = maps.groupBy(*by).agg(F.aggregate(listed, none, composed).alias("_f")).select(*by, *(F.col(f"_f.{c}").alias(c) for c in ("n", "m", "a", "b", "s")))
    return maps.select(key, "n", F.when(F.col("m") > 0, F.col("s")).alias("ema"))


# failure streaks


def breaker(log: DataFrame, key: str, order: str, ok: str, run: int, stop: int) -> DataFrame:
    """Attempts that are reached, with ``trip``: see workplan.circuit_breaker."""
    taken = [*log.columns, "trip"]
    part, pos, isl, streak, lead, tail, oks, own, group, before = (unused(taken, f"_{x}") for x in ("part", "pos", "isl", "streak", "lead", "tail", "oks", "own", "group", "before"))
    rows = in_parts(log, [key, order], part, pos)
    good = F.col(ok).cast("int")
    segment = Window.partitionBy(key, part).orderBy(pos)
    upto, earlier = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)
    x = rows.withColumn(isl, F.coalesce(F.sum(good).over(segment.rowsBetween(*upto)), F.lit(0)))
    x = x.withColumn(streak, F.sum(1 - good).over(Window.partitionBy(key, part, isl).orderBy(pos).rowsBetween(*upto)))
    trips = F.sum(F.when((F.col(isl) > 0) & (good == 0) & (F.col(streak) % run == 0), 1).otherwise(0))
    # a segment: failures before its first success and after its last one, and the trips in between
    s = x.groupBy(key, part).agg(F.coalesce(F.sum(good), F.lit(0)).alias(oks), F.coalesce(F.sum(F.when(F.col(isl) == 0, 1 - good)), F.lit(0)).alias(lead), F.coalesce(F.max_by(streak, pos), F.lit(0)).alias(tail), trips.alias(own))
    of_key = Window.partitionBy(key).orderBy(part)  # one row per part
    s = s.withColumn(group, F.sum((F.col(oks) > 0).cast("int")).over(of_key.rowsBetween(*upto)))
    s = s.withColumn(tail, F.sum(tail).over(Window.partitionBy(key, group).orderBy(part).rowsBetween(*upto)))
    s = s.withColumn(tail, F.coalesce(F.lag(tail).over(of_key), F.lit(0)))  # the streak that a segment begins with
    inside = F.floor((F.col(tail) + F.col(lead)) / run) - F.floor(F.col(tail) / run) + F.col(own)
    s = s.withColumn(before, F.coalesce(F.sum(inside).over(of_key.rowsBetween(*earlier)), F.lit(0)))
    carried = s.select(F.col(key).alias(key + before), F.col(part).alias(part + before), tail, before)
    got = x.join(carried, x[key].eqNullSafe(carried[key + before]) & (x[part] == carried[part + before]))
    got = got.withColumn("trip", (good == 0) & ((F.col(streak) + F.when(F.col(isl) == 0, F.col(tail)).otherwise(0)) % run == 0))
    reached = F.col(before) + F.coalesce(F.sum(F.col("trip").cast("int")).over(segment.rowsBetween(*earlier)), F.lit(0))
    return got.withColumn(before, reached).filter(F.col(before) < stop).select(*log.columns, "trip")


# greedy chains


class Segment:
    """Coordinates of a segment's rows in order, and from a start the coordinate at which the next one may be."""

    def __init__(self, at: np.ndarray, until: np.ndarray):
        self.at, self.until, self.n = at, until, len(at)
        self.next = np.append(np.maximum(np.searchsorted(at, until), np.arange(1, self.n + 1)), self.n)

    def entry(self, wanted: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, wanted)

    def ways(self) -> tuple[np.ndarray, np.ndarray]:
        """From each row, if it is a start: the coordinate that the way leaves for, and its number of starts in here."""
        jump, last, count = self.next.copy(), np.arange(self.n + 1), np.ones(self.n + 1, np.int64)
        count[-1] = 0
        while (jump[:-1] < self.n).any():
            on = jump < self.n
            last = np.where(on, last[np.minimum(jump, self.n)], last)
            count = count + np.where(on, count[jump], 0)
            jump = jump[jump]
        return self.until[last[:-1]], count[:-1]

    def starts(self, first: int) -> np.ndarray:
        """All starts from the first on, in order."""
        found, jump = np.array([first], np.int64), self.next
        while True:
            more = jump[found]
            more = more[more < self.n]
            if not len(more):
                return np.sort(found)
            found, jump = np.concatenate([found, more]), jump[jump]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, int, pa.Table]]:
    """(key, part, rows) of batches whose first columns are key and part, sorted by them."""
    held: list[pa.RecordBatch] = []

    def whole() -> tuple[Any, int, pa.Table]:
        rows = pa.Table.from_batches(held).combine_chunks()
        return rows.column(0)[0].as_py(), rows.column(1)[0].as_py(), rows

    for batch in batches:
        if not len(batch):
            continue
        if held:
            join = pa.concat_tables([pa.Table.from_batches([held[-1].slice(len(held[-1]) - 1)]), pa.Table.from_batches([batch.slice(0, 1)])]).combine_chunks()
            if _changes(join.column(0).combine_chunks(), join.column(1).combine_chunks())[1]:
                yield whole()
                held = []
        cuts = [*np.flatnonzero(_changes(batch.column(0), batch.column(1))).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a:
                yield whole()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield whole()


class Spans:
    """The keys that lie in several parts: of each segment its base (what earlier ones add up to) and its last coordinate."""

    def __init__(self, rows: DataFrame, key: str, size: bool):
        own = rows.groupBy(key, "part").agg(F.sum("size").alias("total") if size else F.lit(0).alias("total"), F.max("at").alias("top"))
        keys = own.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("part", "total", "top"))).alias("s")).filter(F.size("s") > 1).collect()  # twice the parts at most
        self.parts: dict[Any, list[tuple[int, int, int]]] = {}
        for r in keys:
            base, out = 0, []
            for s in r.s:
                out.append((s.part, base, base + s.total if size else s.top))
                base += s.total
            self.parts[r[key]] = out
        self.most = max(map(len, self.parts.values()), default=0)

    def base(self, key: Any, part: int) -> int:
        return next((b for p, b, _ in self.parts.get(key, ()) if p == part), 0)

    def targets(self, key: Any, part: int, wanted: np.ndarray) -> pa.Array:
        """For each coordinate the first later segment with a row there or beyond; null where there is none."""
        parts = np.array([p for p, _, _ in self.parts[key]])
        at = np.maximum(np.searchsorted([top for _, _, top in self.parts[key]], wanted), np.searchsorted(parts, part) + 1)
        return pa.array(parts[np.minimum(at, len(parts) - 1)], mask=at >= len(parts))


def chained(rows: DataFrame, key: str, made: Callable[[pa.Table, int], Segment], out: Callable[[pa.Table, np.ndarray, np.ndarray], list[pa.Array]], schema: T.StructType, size: bool) -> DataFrame:
    """Greedy chains over rows (key, part, pos, at, ...); each key's first row is a start.

    ``made(rows, base)`` gives a segment's coordinates; with ``size``, ``base`` is the sum of the column size over the
    key's earlier segments.  ``out(rows, whether a start, starts so far)`` makes a segment's result.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spans = Spans(rows, key, size)
    entries: dict[tuple[Any, int], tuple[int, int]] = {}
    if spans.parts:
        for r in _reached(rows, key, made, spans, n):
            entries[r[key], r.part] = r.wanted, r.starts
        for k, parts in spans.parts.items():
            so_far = 0
            for p, _, _ in parts:
                wanted, starts = entries.get((k, p), (None, 0))
                entries[k, p] = wanted, so_far
                so_far += starts
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, part, table in _segments(batches):
            wanted, before = entries.get((k, part), (BEGIN, 0)) if k in spans.parts else (BEGIN, 0)
            segment, flag = made(table, spans.base(k, part)), np.zeros(len(table), bool)
            if wanted is not None:
                flag[segment.starts(int(segment.entry(np.array([wanted]))[0]))] = True
            cols = out(table, flag, before + np.cumsum(flag))
            yield from pa.Table.from_arrays(cols, names).cast(to_arrow_schema(schema)).combine_chunks().to_batches(max_chunksize=100_000)

    return rows.repartition(n, key, "part").sortWithinPartitions(key, "part", "pos").mapInArrow(run, schema)


def _reached(rows: DataFrame, key: str, made: Callable[[pa.Table, int], Segment], spans: Spans, n: int) -> list:
    """(key, part, wanted, starts) of the segments that a key's chain enters, with the coordinate that it enters for.

    Where a segment can be left for is known from it alone, so all segments are done at once; then each of these
    entries is followed through its own segment, which gives one step of a way, and the ways are doubled.
    """
    folder, spark = shared_dir(rows.sparkSession, "chains"), rows.sparkSession
    keys = [k for k in spans.parts if k is not None]
    own = F.col(key).isin(keys) if keys else F.lit(False)
    own = own | F.col(key).isNull() if None in spans.parts else own
    rows = rows.filter(own)
    kind = T.StructType([rows.schema[key], *T.StructType.fromDDL("part long, wanted long").fields])

    def gates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, part, table in _segments(batches):
            ways = made(table, spans.base(k, part)).ways()[0]
            wanted = np.unique(ways if part != spans.parts[k][0][0] else ways[:1])
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(wanted), table.schema.field(0).type), spans.targets(k, part, wanted), pa.array(wanted)], kind.names)

    dealt = rows.repartition(n, key, "part").sortWithinPartitions(key, "part", "pos")
    doors = dealt.mapInArrow(gates, kind).filter("part is not null").distinct()
    first = spark.createDataFrame([(k, p[0][0], BEGIN) for k, p in spans.parts.items()], kind)
    doors = doors.union(first).withColumn("_door", F.lit(1))
    both = rows.withColumn("_door", F.lit(0)).unionByName(doors, allowMissingColumns=True)
    columns = [key, "part", "_door", "wanted", *(c for c in rows.columns if c not in (key, "part"))]
    edge = T.StructType([*kind.fields, *T.StructType.fromDDL("to_part long, to_wanted long, starts long").fields])

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, part, table in _segments(batches):
            door = table.column("_door").to_numpy() == 1
            wanted = table.column("wanted").filter(pa.array(door)).to_numpy()
            segment = made(table.drop_columns(["_door", "wanted"]).filter(pa.array(~door)), spans.base(k, part))
            leaves, count = segment.ways()
            at = segment.entry(wanted)
            leaves, count = leaves[at], count[at]
            same = [pa.array([x] * len(at), t) for x, t in ((k, table.schema.field(0).type), (part, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*same, pa.array(wanted), spans.targets(k, part, leaves), pa.array(leaves), pa.array(count)], edge.names)

    edges = written(both.select(*columns).repartition(n, key, "part").sortWithinPartitions(key, "part", "_door", "pos").mapInArrow(steps, edge), f"{folder}/edges")
    def joined(a: DataFrame, b: DataFrame, ends: tuple[str, str], how: str = "inner") -> DataFrame:
        """a with b's way (_to_part, _to_wanted) from where a's columns ``ends`` say."""
        far = b.select(F.col(key).alias("_far_key"), F.col("part").alias("_far_part"), F.col("wanted").alias("_far_wanted"), F.col("to_part").alias("_to_part"), F.col("to_wanted").alias("_to_wanted"))
        return a.join(far, a[key].eqNullSafe(far["_far_key"]) & (a[ends[0]] == far["_far_part"]) & (a[ends[1]] == far["_far_wanted"]), how)

    far = [F.col("_to_part").alias("to_part"), F.col("_to_wanted").alias("to_wanted")]
    jump = edges.select(key, "part", "wanted", "to_part", "to_wanted")
    seen = jump.filter(F.col("wanted") == BEGIN)
    for turn in range((spans.most - 1).bit_length()):
        more = joined(seen, jump, ("to_part", "to_wanted")).select(key, F.col("to_part").alias("part"), F.col("to_wanted").alias("wanted"))
        reached = seen.select(key, "part", "wanted").union(more).distinct()
        jump = written(joined(jump, jump, ("to_part", "to_wanted"), "left").select(key, "part", "wanted", *far), f"{folder}/jump-{turn}")
        seen = written(joined(reached, jump, ("part", "wanted")).select(key, "part", "wanted", *far), f"{folder}/seen-{turn}")
    return joined(edges, seen, ("part", "wanted")).select(key, "part", "wanted", "starts").collect()  # a row for each segment at most
