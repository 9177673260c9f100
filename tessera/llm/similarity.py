"""N-gram Jaccard join: groups of documents linked by a similarity of their shingle sets.

1. Every text becomes a sorted array of 64-bit shingle hashes.  Texts with equal sets are one class,
   represented by their least doc_id (equal by 128 bits of their hash).
2. Shingles are counted over all documents.  A representative's set, ordered from the rarest shingle on,
   needs one shingle of its first n - ceil(t*n) + 1 in common with any partner; of these, those that no
   other document has are left out.
3. A tile holds the documents that such a shingle brings together, in bands by set size.  Within a band the
   sizes, the places of the common shingle and then the hashed bitmaps (a bit is the parity of the shingles
   hashed to it, so the bits that differ count the least number of shingles that differ) bound the overlap
   from above; what is left is verified by the intersection of the sorted arrays.  Pairs already joined
   through others need no check, since only the groups are asked for.
4. The tiles' links are contracted to components.

Bitmaps and arrays are memory-mapped from the shared folder; each attempt of a task writes a file of its own,
which its rows name.  A tile of more than ``block`` documents is
dealt out as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import blocks
from tessera.llm.graphs import components

BITS = 1024
NONE = np.iinfo(np.int64).min
#: Per document (token null) or per necessary shingle of a representative.
ROWS = "doc_id long, n long, rep long, token long, block_a int, block_b int, place int, file long, at long"


def shingle_sets(raw: list[bytes], cache: blocks.Words, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; of fewer than k words the whole sequence; no words: none."""
    h, counts = blocks.hashed([x.lower().split() for x in raw], cache)
    all_, out, first = blocks.windows(h, k), [], 0
    for n in counts.tolist():
        if n >= k:
            out.append(np.unique(all_[first : first + n - k + 1]))
        else:
            out.append(blocks.windows(h[first : first + n], n) if n else all_[:0])
        first += n
    return out


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, in two halves."""
    return divmod(xxhash.xxh3_128_intdigest(s.tobytes(), seed=len(s)), 1 << 64)


def _bitmap(s: np.ndarray) -> np.ndarray:
    return np.packbits(np.bincount((s % blocks.U64(BITS)).astype(np.int64), minlength=BITS) & 1 == 1, bitorder="little").view("u8")


class Sets:
    """Bitmaps and sorted arrays from the files that the second pass wrote."""

    def __init__(self, folder: str):
        self.maps = blocks.Maps(folder)

    def _file(self, f: int) -> np.ndarray:
        return self.maps.get(f"{f:016x}").view("u8")

    def bitmap(self, f: int, at: int) -> np.ndarray:
        return self._file(f)[at : at + BITS // 64]

    def array(self, f: int, at: int, n: int) -> np.ndarray:
        return self._file(f)[at + BITS // 64 : at + BITS // 64 + n]


class Joined:
    """Links found so far in a task."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def match_tile(doc, n, place, file, at, sets: Sets, joined: Joined, percent: int) -> list[tuple[int, int]]:
    """Links of one tile that join groups; the rows are in order of n."""
    root = np.fromiter(map(joined.root, doc.tolist()), np.int64, len(doc))
    label = np.unique(root, return_inverse=True)[1]
    if not label.any():
        return []
    out, bits, hubs, n_labels = [], None, [], len(np.unique(label))
    files, ats, ns, places = file.tolist(), at.tolist(), n.tolist(), place.tolist()
    low = np.searchsorted(n * 100, n * percent)  # the band: partners of smaller size that can reach the threshold

    def maps() -> np.ndarray:
        return np.stack([sets.bitmap(f, a) for f, a in zip(files, ats, strict=True)])

    def verified(i: int, j: int) -> bool:
        x, y = sets.array(files[i], ats[i], ns[i]), sets.array(files[j], ats[j], ns[j])
        common = len(np.intersect1d(x, y, assume_unique=True))
        return (100 + percent) * common >= percent * (ns[i] + ns[j])

    def join(i: int, j: int) -> None:
        nonlocal n_labels
        label[label == label[i]] = label[j]
        n_labels -= 1
        out.append((int(doc[i]), int(doc[j])))
        joined.link(int(doc[i]), int(doc[j]))
        if j not in hubs:
            hubs.insert(0, j)
            del hubs[4:]

    for i in range(1, len(doc)):
        if n_labels == 1:
            break
        bits = maps() if bits is None else bits
        for j in hubs:
            if low[i] <= j < i and label[i] != label[j] and np.bitwise_count(bits[i] ^ bits[j]).sum() * (100 + percent) <= (100 - percent) * (ns[i] + ns[j]) and verified(i, j):
                join(i, j)
        c = np.arange(low[i], i)
        c = c[label[c] != label[i]]
        if not len(c):
            continue
        total = n[c] + ns[i]
        left = 1 + np.minimum(ns[i] - 1 - places[i], n[c] - 1 - place[c])  # if this is the first common shingle
        c = c[(100 + percent) * left >= percent * total]
        if not len(c):
            continue
        apart = np.bitwise_count(bits[c] ^ bits[i]).sum(axis=1, dtype=np.int64)
        some = (100 + percent) * (n[c] + ns[i] - apart) >= 2 * percent * (n[c] + ns[i])
        c = c[some][np.argsort(apart[some], kind="stable")]
        while len(c):
            j = int(c[0])
            if verified(i, j):
                join(i, j)
                c = c[label[c] != label[i]]
            else:
                c = c[1:]
    return out


def similar_groups(docs: DataFrame, k: int = 5, percent: int = 75, block: int = 8192) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least doc_id reached by links, its own included).

    Two documents link when 100 * |A & B| >= percent * |A | B|.  Null, empty and blank texts have no
    shingles and link with nothing.  Rows that repeat a doc_id are one node with the links of each.  A null
    doc_id takes part and is the least; a component that holds it has null as its id.
    """
    spark = docs.sparkSession
    folder, n_shards = blocks.shared_dir(spark, "similarity"), blocks.shards(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, pending = blocks.Words(), blocks.Pending(n_shards)
        for part, raw in blocks.chunks(batches):
            own = shingle_sets(raw, cache, k)
            if rows := pending.add(np.concatenate([np.empty(0, blocks.U64), *own])):
                yield blocks.payload(rows)
            some = [i for i, s in enumerate(own) if len(s)]
            digest, ids = np.array([_digest(own[i]) for i in some], "u8").reshape(-1, 2), blocks.column(part, "doc_id")[some]
            order = np.argsort(digest[:, 0])
            digest, ids = digest[order], ids[order]
            yield blocks.payload([(s + n_shards, x) for s, x in blocks.cut(digest[:, 0], n_shards, lambda a, b, d=digest, i=ids: d[a:b].tobytes() + i[a:b].tobytes())])
        yield blocks.payload(pending.flush())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = []
        for s, parts in blocks.gathered(batches).items():
            if s < n_shards:
                keys, counts = blocks.merged(parts)
                some = counts > 1
                blocks.Lookup.save(f"{folder}/counts", s, keys[some], np.minimum(counts[some], 0xFFFFFFFF).astype("<u4"))
            else:
                digest = np.concatenate([np.frombuffer(x, "u8", len(x) // 12) for x in parts]).reshape(-1, 2)
                ids = np.concatenate([np.frombuffer(x, "i8", len(x) // 24, len(x) // 3 * 2) for x in parts])
                order = np.lexsort((ids, digest[:, 1], digest[:, 0]))
                digest, ids = digest[order], ids[order]
                start = np.flatnonzero(np.r_[True, (digest[1:] != digest[:-1]).any(1)])
                several = np.diff(np.r_[start, len(digest)]) > 1
                keys, rest, ids = digest[start, 0], digest[start, 1], ids[start]
                # of different sets with equal first halves one has a class here; the others meet in tiles
                some = several & np.r_[True, keys[1:] != keys[:-1]]
                blocks.Lookup.save(f"{folder}/classes", s - n_shards, keys[some], rest[some], ids[some])
            sizes.append((s, int(some.sum())))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in sizes], pa.int32()), pa.array([x[1] for x in sizes], pa.int64())], ["shard", "n"])

    made = texts.mapInArrow(first_pass, blocks.PAYLOAD).repartitionById(2 * n_shards, "shard").mapInArrow(merge, "shard int, n long")
    sizes = {r.shard: r.n for r in made.collect()}  # two small rows for each shard
    counts = blocks.Lookup(f"{folder}/counts", {s: x for s, x in sizes.items() if s < n_shards}, n_shards, {"c": "<u4"})
    classes = blocks.Lookup(f"{folder}/classes", {s - n_shards: x for s, x in sizes.items() if s >= n_shards}, n_shards, {"rest": "u8", "rep": "i8"})

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, stored, at = blocks.Words(), blocks.Appender(f"{folder}/sets"), 0
        for part, raw in blocks.chunks(batches):
            own, ids = shingle_sets(raw, cache, k), blocks.column(part, "doc_id")
            size = np.fromiter(map(len, own), np.int64, len(own))
            digest = np.array([_digest(s) for s in own], "u8").reshape(-1, 2)
            same = classes.find(digest[:, 0])
            rep = np.where(same["found"] & (same["rest"] == digest[:, 1]) & (size > 0), same["rep"], ids)
            lead = np.flatnonzero((rep == ids) & (size > 0))
            every = np.concatenate([np.empty(0, blocks.U64), *(own[i] for i in lead)])
            distinct, back = np.unique(every, return_inverse=True)
            c, first = counts.find(distinct)["c"][back], 0
            rows = [(ids, size, rep, np.full(len(ids), NONE), *(np.zeros(len(ids), np.int64) for _ in range(5)))]
            for i in lead.tolist():
                s, ci = own[i], c[first : first + size[i]]
                first += size[i]
                order = np.lexsort((s, ci))[: size[i] - (size[i] * percent + 99) // 100 + 1]
                place = np.flatnonzero(ci[order] > 1)
                if not len(place):
                    continue
                token, parts = s[order[place]].view("i8"), -(-ci[order[place]].astype(np.int64) // block)
                if parts.max() > 1:  # each pair of blocks that has this document's
                    mine, copies = int(xxhash.xxh3_64_intdigest(int(ids[i]).to_bytes(8, "little", signed=True)) >> 16), parts
                    rep_at = np.repeat(np.arange(len(token)), copies)
                    other = np.arange(len(rep_at)) - np.repeat(np.r_[0, np.cumsum(copies)[:-1]], copies)
                    token, place, own_block = token[rep_at], place[rep_at], mine % parts[rep_at]
                    a, b = np.minimum(own_block, other), np.maximum(own_block, other)
                else:
                    a = b = np.zeros(len(token), np.int64)
                rows.append((*(np.full(len(token), x) for x in (ids[i], size[i], rep[i])), token, a, b, place, *(np.full(len(token), x) for x in (stored.number, at))))
                stored.write(_bitmap(s).tobytes() + s.tobytes())
                at += BITS // 64 + len(s)
            cols = [np.concatenate(x).astype(np.int64) for x in zip(*rows, strict=True)]
            kinds = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, mask=(x == NONE) if j == 3 else None).cast(t) for j, (x, t) in enumerate(zip(cols, kinds, strict=True))], [x.split()[0] for x in ROWS.split(", ")]
            )
        stored.close()

    rows = blocks.written(texts.mapInArrow(second_pass, ROWS), f"{folder}/rows")

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, joined, rest = Sets(f"{folder}/sets"), Joined(), None
        names = ["token", "block_a", "block_b", "doc_id", "n", "place", "file", "at"]

        def work(cols: list[np.ndarray], edges: np.ndarray) -> pa.RecordBatch:
            found = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if b - a > 1:
                    found += match_tile(*(x[a:b] for x in cols[3:]), sets, joined, percent)
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

        for batch in batches:
            cols = [blocks.column(batch, x) for x in names]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            new = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])) + 1
            last = int(new[-1]) if len(new) else 0
            yield work(cols, np.r_[0, new]) if last else pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])
            rest = [x[last:] for x in cols]
        if rest is not None:
            yield work(rest, np.array([0, len(rest[0])]))

    key = ["token", "block_a", "block_b"]
    dealt = rows.filter("token is not null").select(*key, "doc_id", "n", "place", "file", "at").repartition(n_shards, *key)
    links = dealt.sortWithinPartitions(*key, "n", "doc_id", "at", "file").mapInArrow(tiles, "a long, b long")
    groups = components(links, f"{folder}/components")
    own = rows.filter("token is null").select("doc_id", "n", "rep")
    # ids that several rows or classes share join these classes as well
    ids = own.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low <> high")
    if ids.take(1):
        more = own.join(ids.select("doc_id"), "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        groups = components(links.union(more), f"{folder}/components-ids")
    out = own.join(groups, own.rep == groups.node, "left")
    id_ = lambda c: F.when(c != F.lit(int(NONE)), c)
    return out.select(id_(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), id_(F.coalesce("component", "rep")).alias("component_id"))


def first_of_groups(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs whose doc_id is the least of its group.

    The ids that go are sorted arrays in the shared folder, so texts are not shuffled.  Rows that repeat a doc_id
    stay or go together; rows without a doc_id stay.
    """
    spark = docs.sparkSession
    folder, n = blocks.shared_dir(spark, "similarity-gone"), blocks.shards(spark)
    gone = similar_groups(docs, k, percent).filter("component_id < doc_id or (component_id is null and doc_id is not null)").select("doc_id")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = blocks.Pending(n)
        for batch in batches:
            if rows := pending.add(blocks.mix(blocks.column(batch, "doc_id").view("u8"))):
                yield blocks.payload(rows)
        yield blocks.payload(pending.flush())

    ids = blocks.kept_counts(gone.mapInArrow(keys, blocks.PAYLOAD), f"{folder}/ids", n, 1)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~ids.find(blocks.mix(blocks.column(batch, "doc_id").view("u8")))["found"]))

    return docs.mapInArrow(keep, docs.schema)
