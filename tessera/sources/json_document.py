"""One JSON document of any size, read by byte ranges and written at byte offsets.

Reading.  A byte range does not show whether it begins inside a string, nor how deep.  A first pass notes of each
range, under both assumptions about its beginning, how many quotes end or open strings and how the depth changes: one
small row for each range.  Quotes alternate, so running sums of these rows give each range the state it begins in.
A second pass finds the values that open in a range at the wanted depth and follows the last one over the range's
end; what a block holds is cut out at once.  A task holds one block and one value.  The number of ranges is bounded by
the session's partitions (``_width``): a longer document makes wider ranges, not more tasks.

Writing.  Each task of the sorted rows joins them to one compressed text and says how long it is; sums of these
lengths give every text its place in the document, and tasks copy them there.  Rows are sorted and sent once.  A
repeated task writes the same bytes to the same places.  On a store without places in files, one task streams the
texts in order.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator, Sequence
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.shared import shared_dir
from tessera.sources.storage import Store

RANGE, BLOCK = 32 << 20, 1 << 20
QUOTE, BACKSLASH = ord('"'), ord("\\")
#: Ranges of a document for each of the session's shuffle partitions, at most.
RANGES = 8
STEP = np.zeros(256, np.int64)
STEP[[ord("{"), ord("[")]] = 1
STEP[[ord("}"), ord("]")]] = -1
#: Fixed pattern: the key before a value.
KEY = re.compile(rb'(?<=[\s{,])("(?:[^"\\]|\\.)*")\s*:\s*$', re.DOTALL)


class Scan:
    """Structure of a file's bytes, block by block: the depth after each byte outside strings."""

    def __init__(self, inside: bool = False, depth: int = 0, escaped: bool = False):
        self.inside, self.depth, self.escaped = inside, depth, escaped

    def marks(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of all brackets, their steps, whether each lies in a string); the depth is left as it is."""
        x = np.frombuffer(raw, np.uint8)
        quote = x == QUOTE
        back = np.flatnonzero(x == BACKSLASH)
        if len(back) or self.escaped:
            hidden = self._hidden(back, len(x))
            quote[hidden[hidden < len(x)]] = False
        quotes = np.flatnonzero(quote)
        folded = x | 0x20  # [ and ] become { and }
        brackets = np.flatnonzero((folded == ord("{")) | (folded == ord("}")))
        within = (np.searchsorted(quotes, brackets) + self.inside) % 2 == 1
        self.inside = bool((self.inside + len(quotes)) % 2)
        return brackets, STEP[x[brackets]], within

    def block(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(places of brackets outside strings, depth after each)."""
        brackets, steps, within = self.marks(raw)
        depth = self.depth + np.cumsum(steps[~within])
        if len(depth):
            self.depth = int(depth[-1])
        return brackets[~within], depth

    def _hidden(self, back: np.ndarray, size: int) -> np.ndarray:
        """Places that a backslash before them hides: every second one of a run hides the next place."""
        if self.escaped and len(back) and back[0] == 0:
            back, first = back[1:], [0]
        else:
            first = [0] if self.escaped else []
        run = np.cumsum(np.r_[True, np.diff(back) != 1]) - 1 if len(back) else np.empty(0, np.int64)
        start = back[np.r_[True, np.diff(run) != 0]] if len(back) else back
        hiding = back[(back - start[run]) % 2 == 0] if len(back) else back
        self.escaped = bool(len(hiding) and hiding[-1] == size - 1)
        return np.r_[np.array(first, np.int64), hiding + 1]


def _escaped_at(f, at: int) -> bool:
    """Whether the byte at a place is hidden by an odd number of backslashes before it."""
    n, width = 0, 64
    while at - n > 0:
        begin = max(0, at - n - width)
        f.seek(begin)
        raw = f.read(at - n - begin)
        own = len(raw) - len(raw.rstrip(b"\\"))
        n += own
        if own < len(raw):
            break
        width *= 2
    return bool(n % 2)


def _blocks(f, start: int, end: int, size: int = BLOCK) -> Iterator[tuple[int, bytes]]:
    """Blocks up to a place; if the first are small, they grow."""
    f.seek(start)
    while start < end and (raw := f.read(min(size, end - start))):
        yield start, raw
        start, size = start + len(raw), min(2 * size, BLOCK)


def _width(spark: SparkSession, size: int, width: int) -> int:
    """Ranges of this width, wider if there were more of them than ``RANGES`` for each shuffle partition."""
    return max(width, -(-size // (RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))))


def _ranges(spark: SparkSession, size: int, width: int) -> DataFrame:
    n = max(1, -(-size // width))
    return spark.range(0, n, 1, n).select(F.col("id").alias("number"), (F.col("id") * width).alias("start"), F.least((F.col("id") + 1) * width, F.lit(size)).alias("end"))


def _table(rows: list, names: Sequence[str], texts: int = 0) -> pa.RecordBatch:
    """Rows as longs, the last columns as texts."""
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i >= len(names) - texts else pa.int64()) for i, c in enumerate(cols)], list(names))


def _entered(ranges: DataFrame, path: str) -> DataFrame:
    """Ranges with the state each begins in, number, start, end, inside (0 or 1), depth, and its least depth, low."""
    names = ("number", "start", "end", "odd", "outside", "within", "low_outside", "low_within")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for number, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                depth, low = [0, 0], [0, 0]  # if the range begins outside a string, and inside
                with Store(path).open() as f:
                    scan = Scan(False, 0, _escaped_at(f, start))
                    for _, raw in _blocks(f, start, end):
                        _, steps, within = scan.marks(raw)
                        for i, own in enumerate((steps[~within], steps[within])):
                            if len(own):
                                after = depth[i] + np.cumsum(own)
                                depth[i], low[i] = int(after[-1]), min(low[i], int(after.min()))
                rows.append((number, start, end, int(scan.inside), *depth, *low))
            yield _table(rows, names)

    seen = ranges.mapInArrow(run, ", ".join(f"{n} long" for n in names))
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)  # one small row for each range
    seen = seen.withColumn("inside", F.pmod(F.coalesce(F.sum("odd").over(before), F.lit(0)), F.lit(2)))
    own = lambda name: F.when(F.col("inside") == 1, F.col(f"{name}within")).otherwise(F.col(f"{name}outside"))
    seen = seen.withColumn("depth", F.coalesce(F.sum(own("")).over(before), F.lit(0)))
    return seen.select("number", "start", "end", "inside", "depth", (F.col("depth") + own("low_")).alias("low"))


def _key(f, at: int) -> str | None:
    """The key of the value that opens at a place; null for an array's item."""
    width = 256
    while True:
        begin = max(0, at - width)
        f.seek(begin)
        raw = f.read(at - begin)
        if found := KEY.search(raw):
            return json.loads(found[1])
        if begin == 0 or raw.rstrip()[-1:] not in (b":", b""):
            return None
        width *= 4


def _found(path: str, level: int, start: int, end: int, inside: bool, depth: int, texts: bool) -> Iterator[tuple[np.ndarray, list[str | None] | None, list[bytes] | None]]:
    """What opens in a range, in order: ([place], [key], None) of a section, (places, keys, texts) of values of a block.

    Sections open from ``level`` - 1 and values from ``level``; a value's key is looked up on level 1 alone, else null.
    """
    with Store(path).open() as f, Store(path).open() as keys:
        scan, now, parts = Scan(inside, depth, _escaped_at(f, start)), None, []
        for at, raw in chain(_blocks(f, start, end), _blocks(f, end, 1 << 62, 4096)):
            if at >= end and now is None:
                return
            places, depths = scan.block(raw)
            opens = STEP[np.frombuffer(raw, np.uint8)[places]] == 1
            own = opens & (places < end - at)
            sections = places[own & (depths == level)] if level > 1 else places[:0]
            if texts:
                begins, ends = places[own & (depths == level + 1)], places[~opens & (depths == level)] + 1
                if now is not None:
                    if not len(ends):
                        parts.append(raw)
                        continue
                    text = b"".join([*parts, raw[: ends[0]]])
                    yield np.array([now]), [_key(keys, now)] if level == 1 else None, [text]
                    now, parts, ends = None, [], ends[1:]
                elif len(ends) and (not len(begins) or ends[0] <= begins[0]):  # of a value that began before the range
                    ends = ends[1:]
                if len(begins) > len(ends):
                    now, parts, begins = at + int(begins[-1]), [raw[begins[-1] :]], begins[:-1]
                ends = ends[: len(begins)]
            cuts = np.searchsorted(begins, sections).tolist() if texts else [0] * len(sections)
            for i, (a, b) in enumerate(pairwise([0, *cuts, len(begins) if texts else 0])):
                if b > a:
                    here = begins[a:b] + at
                    yield here, [_key(keys, p) for p in here.tolist()] if level == 1 else None, [raw[p:q] for p, q in zip(begins[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                if i < len(sections):
                    yield sections[i : i + 1] + at, [_key(keys, at + int(sections[i]))], None


def _events(path: str, level: int, start: int, end: int, inside: bool, depth: int, texts: bool) -> Iterator[tuple[int, str | None, bytes | None]]:
    """(place, key, None) of each section that opens in the range and (place, key, text) of each value, one by one."""
    for places, keys, found in _found(path, level, start, end, inside, depth, texts):
        yield from zip(places.tolist(), keys or [None] * len(places), found or [None] * len(places), strict=True)


def values(spark: SparkSession, path: str, level: int, width: int = RANGE) -> DataFrame:
    """(place, section, value): objects and arrays that open ``level`` deep in the document, as JSON text.

    Level 1: the values of a top object, with their key as section.  Level 2: what is in those values (the items of
    arrays), with the key of the one it is in.  Scalars are left out; an empty document has no values.
    """
    size = Store(path).size()
    width = _width(spark, size, width)
    n = max(1, -(-size // width))
    ranges = _entered(_ranges(spark, size, width), path).withColumn("section", F.lit(None).cast("string"))
    if level > 1:  # the section that a range begins in: the last one that opened before it

        def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for number, start, end, inside, depth, low, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    section = None
                    for _, section, _ in _events(path, level, start, end, bool(inside), depth, False) if low < level else ():
                        pass
                    rows.append((number, start, end, inside, depth, low, section))
                yield _table(rows, ("number", "start", "end", "inside", "depth", "low", "section"), 1)

        seen = ranges.repartition(n).mapInArrow(last, "number long, start long, end long, inside long, depth long, low long, section string")
        before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)  # one small row for each range
        ranges = seen.withColumn("section", F.last("section", ignorenulls=True).over(before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, start, end, inside, depth, _, section in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for places, keys, texts in _found(path, level, start, end, bool(inside), depth, True):
                    if texts is None:
                        section = keys[0]
                        continue
                    sections = pa.array(keys, pa.string()) if level == 1 else pa.repeat(pa.scalar(section, pa.string()), len(texts))
                    yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), sections, pa.array(texts, pa.string())], ["place", "section", "value"])

    return ranges.repartition(n).mapInArrow(run, "place long, section string, value string")


def write_pieces(spark: SparkSession, path: str, pieces: Sequence[bytes | DataFrame]) -> None:
    """A document of literal texts and of the JSON texts, ``value``, of sorted frames in between.

    A frame's rows are written in their order with commas between them.  The file appears when it is whole.
    """
    store, at, placed, folder = Store(path), 0, [], shared_dir(spark, "texts")
    for piece in pieces:
        if isinstance(piece, bytes):
            placed.append((at, piece, None))
            at += len(piece)
            continue
        parts = piece.select("value").mapInArrow(_joined(folder), "part long, name string, size long").collect()  # one small row for each part
        for i, (_, name, size) in enumerate(sorted(parts)):
            placed.append((at, b"," if i else b"\n", name))
            at += size + 1
    rows = spark.createDataFrame(placed, "at long, text binary, name string")
    if store.fs is not None:
        rows.repartition(1).sortWithinPartitions("at").mapInArrow(_copied(folder, _streamed(path)), "n long").agg(F.sum("n")).collect()
        return
    final = store.path()
    os.makedirs(os.path.dirname(final) or ".", exist_ok=True)
    hidden = f"{os.path.dirname(final)}/.{uuid.uuid4().hex}"
    with open(hidden, "wb") as f:
        f.truncate(at)
    rows.repartition(len(placed)).mapInArrow(_copied(folder, _at_places(hidden)), "n long").agg(F.sum("n")).collect()
    os.replace(hidden, final)


def _joined(folder: str):
    """A task's texts with commas between them as a file of its own; an attempt's file has a name of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, store, size, f = uuid.uuid4().hex, Store(folder), 0, None
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                text = b",".join(batch.column(0).cast(pa.binary()).to_pylist())
                if f is None:
                    files = store.fs or fs.LocalFileSystem()
                    files.create_dir(store.path(), recursive=True)
                    f = files.open_output_stream(store.path(name), compression="lz4")
                else:
                    text = b"," + text
                f.write(text)
                size += len(text)
        finally:
            if f is not None:
                f.close()
        if f is not None:
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "name": [name], "size": [size]})

    return run


def _copied(folder: str, write):
    """Hand texts and the files after them on to ``write``, block by block, as (at, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[pa.RecordBatch]:
            row = lambda at, text: pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([text], pa.binary())], ["at", "text"])
            store = Store(folder)
            for batch in batches:
                for at, text, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield row(at, text)
                    at += len(text)
                    if name is not None:
                        with (store.fs or fs.LocalFileSystem()).open_input_stream(store.path(name), compression="lz4") as f:
                            while raw := f.read(BLOCK):
                                yield row(at, raw)
                                at += len(raw)

        yield from write(blocks())

    return run


def _at_places(file: str):
    """Write rows at their places; rows that follow each other go together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, f = 0, os.open(file, os.O_WRONLY)
        try:
            for batch in batches:
                at, text = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                start = 0
                for i in range(1, len(at) + 1):
                    if i == len(at) or at[i] != at[i - 1] + len(text[i - 1]):
                        whole, place = memoryview(b"".join(text[start:i])), at[start]
                        while whole:
                            done = os.pwrite(f, whole, place)
                            whole, place, n = whole[done:], place + done, n + done
                        start = i
        finally:
            os.close(f)
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    return run


def _streamed(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Store(path).write("", (x for batch in batches for x in batch.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([0])], ["n"])

    return run


def as_values(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows as JSON texts in ``value``; with a key column, as the entries of an object."""
    text = F.to_json(F.struct(*(c for c in df.columns if c != key)))
    return df.withColumn("value", text if key is None else F.concat(F.to_json(F.array(F.col(key).cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(F.col(key).cast("string")))) - 2), F.lit(":"), text))


def write_sections(path: str, sections: dict[str, tuple[DataFrame, list[str]]]) -> None:
    """An object of arrays: each section's rows in their order."""
    pieces: list[bytes | DataFrame] = []
    for i, (name, (df, order)) in enumerate(sections.items()):
        pieces += [("{" if i == 0 else "\n],").encode() + json.dumps(name).encode() + b":[", as_values(df.orderBy(*order))]
    first = next(iter(sections.values()))[0]
    write_pieces(first.sparkSession, path, [*pieces, b"\n]}"])


def write_entries(path: str, df: DataFrame, key: str) -> None:
    """One object of the rows by key, in the order of keys; keys are to be unique and not null."""
    write_pieces(df.sparkSession, path, [b"{", as_values(df.orderBy(key), key), b"\n}"])
