"""Removal of repeated passages by seed and extend.

Anchors are word shingles chosen by winnowing: each window of ``length`` words has one (its smallest shingle
hash), so two equal windows always share it, at the same place.  Documents meet on anchors that occur more than
once.  From such an anchor a match is extended both ways by taking every window around it that chose it: places
match over ``length`` words or more exactly where they share such windows, and the union of the windows that
occur more than once is a document's maximal repeats.

Places of an anchor are not compared pair by pair: a passage that a third of all rows share would make the square
of its places.  Instead windows are counted under their anchor, first in every task, so that such a passage is a row
per task in the exchange, and a hot anchor's windows are dealt to all shards.  Windows are equal by two hashes,
of the anchor (64 bits) and of all words (64 bits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import blocks

RESULT = "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start:long,end:long>>"


def _sliding(x: np.ndarray, k: int, pick) -> np.ndarray:
    """Minimum or maximum of each k consecutive values."""
    width = 1
    while 2 * width <= k:
        x, width = pick(x[:-width], x[width:]), 2 * width
    return pick(x[: len(x) - (k - width)], x[k - width :]) if k > width else x


class Chunk:
    """Windows of some texts: whole (their hash) and seed (the hash of the chosen shingle), where valid."""

    def __init__(self, raw: list[bytes], cache: blocks.Words, length: int, seed: int):
        self.words = [x.split() for x in raw]
        self.h, self.counts = blocks.hashed(self.words, cache)
        self.valid = blocks.inside(self.counts, length)
        self.shingles = blocks.windows(self.h, seed)
        self.seed = _sliding(self.shingles, length - seed + 1, np.minimum) if len(self.valid) else self.shingles[:0]
        self.length, self.span = length, length - seed + 1

    def chosen(self) -> np.ndarray:
        """Hashes of the seeds, one for each place that some window chose."""
        if not len(self.valid):
            return self.shingles[:0]
        low = np.where(self.valid, self.seed, blocks.U64(0))
        edge = np.zeros(self.span - 1, blocks.U64)
        top = _sliding(np.concatenate([edge, low, edge]), self.span, np.maximum)
        return self.shingles[(top == self.shingles) & (top > 0)]

    def hits(self, seeds: blocks.Lookup) -> np.ndarray:
        """Places of the valid windows whose seed is among those."""
        at = np.flatnonzero(self.valid)
        own, back = np.unique(self.seed[at], return_inverse=True)
        return at[seeds.find(own)["found"][back]]

    def whole(self, at: np.ndarray) -> np.ndarray:
        return blocks.windows(self.h, self.length)[at] if len(at) else np.empty(0, blocks.U64)


def tally(whole: np.ndarray, anchor: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows under their anchors, in order, and their counts."""
    order = np.argsort(whole)
    w, a = whole[order], anchor[order]
    if ((w[1:] == w[:-1]) & (a[1:] != a[:-1])).any():  # one hash of two windows
        order = np.lexsort((anchor, whole))
        w, a = whole[order], anchor[order]
    first = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (a[1:] != a[:-1])]) if len(w) else np.empty(0, np.int64)
    if counts is None:
        total = np.diff(np.r_[first, len(w)])
    else:
        total = np.add.reduceat(counts[order], first) if len(first) else counts
    return w[first], a[first], total


def dealt(held: list[tuple], n: int) -> list[tuple[int, bytes]]:
    if not held:
        return []
    whole, anchor, count = tally(*map(np.concatenate, zip(*held, strict=True)))
    count = np.minimum(count, 2).astype("u1")  # once or more often
    return blocks.cut(whole, n, lambda a, b: whole[a:b].tobytes() + anchor[a:b].tobytes() + count[a:b].tobytes())


def _read(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw) // 17
    return np.frombuffer(raw, "u8", n), np.frombuffer(raw, "u8", n, 8 * n), np.frombuffer(raw, "u1", n, 16 * n).astype(np.int64)


def remove_repeats(docs: DataFrame, length: int = 35, seed: int = 8) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (words left, joined by a blank), removed (word spans).

    A word goes if a window of ``length`` words that covers it also starts elsewhere, in the same text or
    in another row (rows that repeat a doc_id are separate texts).  Null and empty texts: no words, kept ''.
    Texts shorter than a window stay as they are.
    """
    spark = docs.sparkSession
    folder, n = blocks.shared_dir(spark, "repeats"), blocks.shards(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def seeds_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, pending = blocks.Words(), blocks.Pending(n)
        for _, raw in blocks.chunks(batches):
            if rows := pending.add(Chunk(raw, cache, length, seed).chosen()):
                yield blocks.payload(rows)
        yield blocks.payload(pending.flush())

    seeds = blocks.kept_counts(texts.mapInArrow(seeds_of, blocks.PAYLOAD), f"{folder}/seeds", n, 2)

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, held = blocks.Words(), []
        for _, raw in blocks.chunks(batches):
            c = Chunk(raw, cache, length, seed)
            at = c.hits(seeds)
            held.append(tally(c.whole(at), c.seed[at]))
            if sum(len(x[0]) for x in held) > 2_000_000:
                yield blocks.payload(dealt(held, n))
                held = []
        yield blocks.payload(dealt(held, n))

    def repeated_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = []
        for s, parts in blocks.gathered(batches).items():
            whole, anchor, count = tally(*map(np.concatenate, zip(*map(_read, parts), strict=True)))
            some = count > 1
            blocks.Lookup.save(f"{folder}/windows", s, whole[some], anchor[some])
            sizes.append((s, int(some.sum())))
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in sizes], pa.int64()) for j in range(2)], ["shard", "n"])

    rows = texts.mapInArrow(windows_of, blocks.PAYLOAD).repartitionById(n, "shard").mapInArrow(repeated_ones, "shard long, n long").collect()  # a small row for each shard
    repeated = blocks.Lookup(f"{folder}/windows", {r.shard: r.n for r in rows}, n, {"anchor": "u8"})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = blocks.Words()
        for part, raw in blocks.chunks(batches):
            c = Chunk(raw, cache, length, seed)
            at = c.hits(seeds)
            found = repeated.find(c.whole(at))
            at = at[found["found"] & (found["anchor"] == c.seed[at])]
            edge = np.zeros(len(c.h) + 1, np.int64)
            edge[at] += 1
            edge[at + length] -= 1
            gone = np.cumsum(edge)[:-1] > 0
            kept, spans, removed, first = [], [], [], 0
            for words, size in zip(c.words, c.counts.tolist(), strict=True):
                own = gone[first : first + size]
                first += size
                if own.any():
                    turn = np.flatnonzero(np.diff(np.r_[False, own, False])).reshape(-1, 2).tolist()
                    words = [w for w, x in zip(words, own.tolist(), strict=True) if not x]
                    spans.append([{"start": a, "end": b} for a, b in turn])
                else:
                    spans.append([])
                removed.append(size - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array(c.counts), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                ["doc_id", "n_words", "n_removed", "kept", "removed"],
            )

    return texts.mapInArrow(cut, RESULT)
