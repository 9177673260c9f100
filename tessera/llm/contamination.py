"""Benchmark decontamination as a prefix-filtered containment join.

The sets are the word shingles (``shingle`` words) of windows of ``size`` consecutive item words; a shorter item is
one window, and one shorter than a shingle is its own shingle.  Shingles are ordered by how often all documents
have them.  Since a window must be contained as a whole, its necessary prefix is one shingle, the rarest;
windows with a shingle that no document has are in none.  Documents are joined with windows on that shingle; its
place in the window bounds where the window can start, the document's length bounds where it can end; the
hash of the whole window and then its words, as they are, verify what is left.

Shingles, their counts and the windows by prefix are dealt by hash to shards, each a sorted file in the shared
folder; no task holds the whole benchmark, and documents never leave their partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import blocks

FOUND = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<long>"
RESULT = [x.split()[0] for x in FOUND.split(", ")]
#: A null item_id among sorted numbers.
NONE = np.iinfo(np.int64).min


def _split(raw: list[bytes]) -> list[list[bytes]]:
    return [x.translate(blocks.ALNUM).split() for x in raw]


def _texts(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.col("text").cast("string").alias("text"))


def item_windows(items: DataFrame, size: int = 10) -> DataFrame:
    """One row per distinct (item, window): id, n (words), words (joined by a blank)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in blocks.chunks(batches):
            ids, ns, own = [], [], []
            for doc, words in zip(part.column(0).to_pylist(), _split(raw), strict=True):
                n = min(size, len(words))
                for w in {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if n else ():
                    ids.append(doc), ns.append(n), own.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int32()), pa.array(own, pa.binary())], ["id", "n", "words"])

    return _texts(items, "item_id").mapInArrow(run, "id long, n int, words binary").distinct()


def _by_length(batch: pa.RecordBatch, shingle: int, cache: blocks.Words) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """For the windows (columns n, words) of each length: their rows, the length, their shingles and their hashes."""
    lengths = batch.column(batch.schema.get_field_index("n")).to_numpy()
    texts = batch.column(batch.schema.get_field_index("words")).to_pylist()
    for n in np.unique(lengths).tolist():
        rows, k = np.flatnonzero(lengths == n), min(shingle, n)
        h, _ = blocks.hashed([texts[i].split() for i in rows], cache)
        at = np.arange(len(rows)) * n
        yield rows, n, blocks.windows(h, k)[at[:, None] + np.arange(n - k + 1)], blocks.windows(h, n)[at]


class Filter:
    """Whether a hash may be a key of a lookup, by its high bits: a table of fixed size, right for any number of keys."""

    BITS = 23

    def __init__(self, keys: Iterator[np.ndarray]):
        self.table = np.zeros(1 << self.BITS, bool)
        for x in keys:
            self.table[x >> blocks.U64(64 - self.BITS)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        return self.table[h >> blocks.U64(64 - self.BITS)]


class Index:
    """Windows by their prefix, from a file for each shard; sizes: numbers of windows, items and bytes of words.

    A shard has, in the order of prefixes: token, whole (hash of the window), first (place of its items), start (of its
    words), place (of the prefix in it) and n; then the items and the words.
    """

    def __init__(self, folder: str, sizes: dict[int, tuple[int, int, int]], n_shards: int):
        self.maps, self.sizes, self.n = blocks.Maps(folder), sizes, n_shards

    @staticmethod
    def save(folder: str, shard: int, rows: list[tuple]) -> tuple[int, int, int]:
        """rows: (token, words, place, n, whole, item), of which equal windows become one."""
        rows.sort(key=lambda r: (r[0], r[1], r[5]))
        new = [i for i, r in enumerate(rows) if i == 0 or rows[i - 1][:2] != r[:2]]
        token, words, place, n, whole, _ = zip(*(rows[i] for i in new), strict=True)
        start = np.cumsum([0, *map(len, words)])
        columns = [np.array(token, "u8"), np.array(whole, "u8"), np.array([*new, len(rows)], "u8"), start.astype("u8"), np.array(place, "i4"), np.array(n, "i4"), np.array([r[5] for r in rows], "i8")]
        blocks.put(f"{folder}/{shard:06d}", [*(x.tobytes() for x in columns), *words])
        return len(new), len(rows), int(start[-1])

    def shard(self, s: int) -> dict[str, np.ndarray]:
        raw, (w, i, _), at, got = self.maps.get(f"{s:06d}"), self.sizes[s], 0, {}
        for name, kind, n in (("token", "u8", w), ("whole", "u8", w), ("first", "u8", w + 1), ("start", "u8", w + 1), ("place", "i4", w), ("n", "i4", w), ("items", "i8", i)):
            width = np.dtype(kind).itemsize * n
            got[name] = raw[at : at + width].view(kind)
            at += width
        return got | {"words": raw[at:]}


def _spread(at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """at[i], at[i]+1, ... count[i] numbers of each."""
    return np.repeat(at - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())


class Chunk:
    """Words of some documents and where each document starts and ends among them."""

    def __init__(self, raw: list[bytes], cache: blocks.Words):
        self.words = _split(raw)
        self.h, self.counts = blocks.hashed(self.words, cache)
        self.ends = np.cumsum(self.counts)
        self.firsts = self.ends - self.counts
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.kept: dict[int, np.ndarray] = {}

    def windows(self, k: int) -> np.ndarray:
        if k not in self.kept:
            self.kept[k] = blocks.windows(self.h, k)
        return self.kept[k]

    def likely(self, k: int, may: Filter) -> np.ndarray:
        """Places of shingles of k words that may be keys."""
        return np.flatnonzero(may(self.windows(k)) & blocks.inside(self.counts, k))

    def hits(self, index: Index, may: Filter, sizes: list[int], shingle: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, places, windows) of all verified occurrences."""
        for k in sizes:
            places = self.likely(k, may)
            keys = self.windows(k)[places]
            for s, part in blocks.by_shard(blocks.shard_of(keys, index.n), index.n):
                if s not in index.sizes:
                    continue
                own = index.shard(s)
                lo, hi = np.searchsorted(own["token"], keys[part]), np.searchsorted(own["token"], keys[part], "right")
                some = hi > lo
                entry, at = _spread(lo[some], (hi - lo)[some]), np.repeat(places[part][some], (hi - lo)[some])
                doc, n, at = self.doc[at], own["n"][entry], at - own["place"][entry]
                ok = (at >= self.firsts[doc]) & (at + n <= self.ends[doc]) & (np.minimum(n, shingle) == k)
                entry, at, n = entry[ok], at[ok], n[ok]
                good = np.zeros(len(entry), bool)
                for m in np.unique(n).tolist():
                    same = np.flatnonzero(n == m)
                    good[same] = self.windows(m)[at[same]] == own["whole"][entry[same]]
                good[good] = [self.same_words(a, e, own) for a, e in zip(at[good].tolist(), entry[good].tolist(), strict=True)]
                yield s, at[good], entry[good]

    def same_words(self, at: int, entry: int, own: dict[str, np.ndarray]) -> bool:
        doc = int(self.doc[at])
        first = at - int(self.firsts[doc])
        found = b" ".join(self.words[doc][first : first + int(own["n"][entry])])
        return found == own["words"][int(own["start"][entry]) : int(own["start"][entry + 1])].tobytes()


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, shingle: int = 5) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (array of item ids).

    Null and empty texts have no words and no hits; rows that repeat a doc_id each give a row; an empty
    benchmark hits nothing; items without words have no window.  A null item_id is an item with an empty name.
    """
    return with_hits(_texts(docs, "doc_id").withColumnRenamed("id", "doc_id"), items, size, shingle).drop("text")


def with_hits(docs: DataFrame, items: DataFrame, size: int = 10, shingle: int = 5) -> DataFrame:
    """docs (doc_id, text as string and any others) with what decontaminate() finds for each row."""
    spark = docs.sparkSession
    folder, n_shards = blocks.shared_dir(spark, "contamination"), blocks.shards(spark)
    found = blocks.written(item_windows(items, size), f"{folder}/windows")
    sizes = sorted({min(shingle, r.n) for r in found.select("n").distinct().collect()})  # numbers up to the shingle's

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, pending = blocks.Words(), blocks.Pending(n_shards)
        for batch in batches:
            for _, _, own, _ in _by_length(batch, shingle, cache):
                if rows := pending.add(own.ravel()):
                    yield blocks.payload(rows)
        yield blocks.payload(pending.flush())

    vocabulary = blocks.kept_counts(found.mapInArrow(shingles, blocks.PAYLOAD), f"{folder}/vocabulary", n_shards, 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, pending, may = blocks.Words(), blocks.Pending(n_shards), Filter(vocabulary.shard(s)["key"] for s, n in vocabulary.sizes.items() if n)
        for _, raw in blocks.chunks(batches):
            chunk = Chunk(raw, cache)
            for k in sizes:
                keys = chunk.windows(k)[chunk.likely(k, may)]
                if rows := pending.add(keys[vocabulary.find(keys)["found"]]):
                    yield blocks.payload(rows)
        yield blocks.payload(pending.flush())

    counts = blocks.kept_counts(_texts(docs, "doc_id").mapInArrow(count, blocks.PAYLOAD), f"{folder}/counts", n_shards, 1)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = blocks.Words()
        for batch in batches:
            for rows, _, own, whole in _by_length(batch, shingle, cache):
                c = counts.find(own.ravel())["c"].reshape(own.shape).astype(np.int64)
                some = np.flatnonzero(c.min(1) > 0)  # a shingle that no document has: the window is in none
                place = np.lexsort((own[some], c[some]))[:, 0] if len(some) else some
                token, taken = own[some, place], batch.take(pa.array(rows[some]))
                more = [pa.array(x) for x in (blocks.shard_of(token, n_shards).astype("i4"), token.view("i8"), place.astype("i4"), whole[some].view("i8"))]
                yield pa.RecordBatch.from_arrays([*more, *taken.columns], ["shard", "token", "place", "whole", *taken.schema.names])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, list[tuple]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                item = NONE if r["id"] is None else r["id"]
                of.setdefault(r["shard"], []).append((r["token"] % (1 << 64), r["words"], r["place"], r["n"], r["whole"] % (1 << 64), item))
        made = [(s, *Index.save(f"{folder}/index", s, rows)) for s, rows in of.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in made], pa.int64()) for j in range(4)], ["shard", "w", "i", "b"])

    dealt = found.mapInArrow(prefixes, "shard int, token long, place int, whole long, id long, n int, words binary").repartitionById(n_shards, "shard")
    index = Index(f"{folder}/index", {r.shard: (r.w, r.i, r.b) for r in dealt.mapInArrow(build, "shard long, w long, i long, b long").collect()}, n_shards)  # a small row for each shard

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, may = blocks.Words(), Filter(index.shard(s)["token"] for s in index.sizes)
        for part, raw in blocks.chunks(batches):
            chunk = Chunk(raw, cache)
            edge = np.zeros(len(chunk.h) + 1, np.int64)
            items: list[set[int]] = [set() for _ in chunk.counts]
            for s, at, entry in chunk.hits(index, may, sizes, shingle):
                own = index.shard(s)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + own["n"][entry], -1)
                for d, e in {*zip(chunk.doc[at].tolist(), entry.tolist(), strict=True)}:
                    items[d].update(own["items"][int(own["first"][e]) : int(own["first"][e + 1])].tolist())
            hit = np.cumsum(edge)[:-1] > 0
            n_hit = np.bincount(chunk.doc[hit], minlength=len(chunk.counts))
            lists = [sorted("" if i == NONE else str(i) for i in s) for s in items]
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns, pa.array(chunk.counts), pa.array(n_hit.astype(np.int64)), pa.array([len(s) for s in lists], pa.int64()),
                    pa.array([hashlib.sha256(",".join(s).encode()).hexdigest() for s in lists], pa.string()), pa.array(n_hit > 0),
                    pa.array([sorted(s) for s in items], pa.list_(pa.int64())),
                ],
                [*part.schema.names, *RESULT],
            )

    return docs.mapInArrow(match, T.StructType([*docs.schema.fields, *T.StructType.fromDDL(FOUND).fields]))
