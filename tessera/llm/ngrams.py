"""Interpolated modified Kneser-Ney language model, counted in Spark and scored from memory-mapped arrays.

Words and n-grams are counted in every task, added up by hash shard and stored as sorted hash arrays in the
shared folder.  The top order has plain counts; each lower one counts the different words before an n-gram.
An order's n-grams lie under their contexts: contexts with one follower are a sorted array of hashes with that
word and count; the others have, by sorted hashes, their totals, the numbers of followers seen once and
twice, and the place of their followers (words in order, with counts).  Workers map the files and look up the
distinct contexts of a few megabytes of text at a time.

A word is known by its rank among the sorted hashes of the vocabulary, so an order-n record is n numbers of
four bytes (up to 4,294,967,293 different words).  Between tasks, records travel in order and packed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import blocks

#: Hash of the end of a text; no word has a line break.
END = np.array([xxhash.xxh3_64_intdigest(b"\n")], "u8")
START, UNKNOWN = 0xFFFFFFFF, 0xFFFFFFFE
SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _key(grams: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of word ranks."""
    out = np.full(len(grams), grams.shape[1], "u8")
    for j in range(grams.shape[1]):
        out = blocks.mix(out * blocks.U64(blocks.BASE) + grams[:, j].astype("u8") + blocks.U64(1))
    return out


def _tokens(raw: list[bytes], cache: blocks.Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each with its end, and the tokens of each text."""
    h, counts = blocks.hashed([x.lower().split() for x in raw], cache)
    return np.insert(h, np.cumsum(counts), END[0]), counts + 1


def _grams(ids: np.ndarray, counts: np.ndarray, order: int) -> np.ndarray:
    """For each token the order-gram that it ends; before the first token stand starts."""
    out = np.full((len(ids), order), START, "u4")
    place = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
    for back in range(order):
        some = place >= back
        out[some, order - 1 - back] = ids[np.flatnonzero(some) - back]
    return out


def _ranks(h: np.ndarray, words: blocks.Lookup) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each word (UNKNOWN if new) and its count."""
    own, back = blocks.grouped(h)
    got = words.find(own)
    return np.where(got["found"], got["rank"], UNKNOWN).astype("u4")[back], got["c"][back]


def _merge(grams: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, in order, and their total counts (without counts: how often each is there)."""
    order = np.argsort(grams[:, -1], kind="stable")
    for j in range(grams.shape[1] - 2, -1, -2):  # two columns at a time
        left = grams[:, j - 1].astype("u8") << blocks.U64(32) if j else blocks.U64(0)
        order = order[np.argsort((left | grams[:, j].astype("u8"))[order], kind="stable")]
    grams = grams[order]
    new = np.r_[True, (grams[1:] != grams[:-1]).any(1)] if len(grams) else np.empty(0, bool)
    first = np.flatnonzero(new)
    if counts is None:
        total = np.diff(np.r_[first, len(grams)])
    else:
        total = np.add.reduceat(counts[order], first) if len(first) else counts
    return grams[first], total


def _contexts(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each context of ordered n-grams starts, and its hash (single words: each by itself)."""
    if grams.shape[1] == 1:
        return np.arange(len(grams)), _key(grams)
    first = np.flatnonzero(np.r_[True, (grams[1:, :-1] != grams[:-1, :-1]).any(1)]) if len(grams) else np.empty(0, np.int64)
    return first, _key(grams[first, :-1])


def _packed(grams: np.ndarray, counts: np.ndarray) -> bytes:
    """Ordered n-grams and counts, columns apart and bytes of like weight together, compressed."""
    columns = [*grams.T, np.minimum(counts, 0xFFFFFFFF).astype("u4")]
    columns[0] = np.diff(columns[0], prepend=columns[0][:1] * 0)
    return zstandard.ZstdCompressor(1).compress(b"".join(np.ascontiguousarray(c).astype("<u4").view("u1").reshape(-1, 4).T.tobytes() for c in columns))


def _unpacked(raw: bytes, m: int) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "u1").reshape(m + 1, 4, -1)
    columns = [np.ascontiguousarray(c.T).view("<u4")[:, 0] for c in flat]
    columns[0] = np.cumsum(columns[0], dtype="u4")
    return np.stack(columns[:m], 1), columns[m].astype(np.int64)


def _deal(grams: np.ndarray, counts: np.ndarray, n: int) -> list[tuple[int, bytes]]:
    """Ordered distinct n-grams by the shard of their context, so that all followers of one are together."""
    first, key = _contexts(grams)
    shard = np.repeat(blocks.shard_of(key, n), np.diff(np.r_[first, len(grams)])).astype("u2" if n <= 1 << 16 else "u4")
    order = np.argsort(shard, kind="stable")
    grams, counts, at = grams[order], counts[order], np.searchsorted(shard[order], np.arange(n + 1))
    return [(s, _packed(grams[at[s] : at[s + 1]], counts[at[s] : at[s + 1]])) for s in range(n) if at[s + 1] > at[s]]


class Followers:
    """An order's n-grams under their contexts, from the files that save() made of each shard.

    one: sorted context hashes, the only follower of each and its count.  many: sorted context hashes, place and
    number of the followers, total, and how many have counts of one and two.  next: the followers' words and counts
    (one byte; 255: the count is in ``big`` under its place).
    """

    def __init__(self, folder: str, sizes: dict[int, list[int]], n_shards: int):
        self.n, self.sizes, self.next = n_shards, sizes, blocks.Maps(f"{folder}-next")
        self.one = blocks.Lookup(f"{folder}-one", {s: x[0] for s, x in sizes.items() if x[0]}, n_shards, {"word": "<u4", "count": "u1"})
        self.many = blocks.Lookup(f"{folder}-many", {s: x[1] for s, x in sizes.items() if x[1]}, n_shards, {"at": "<u8", "size": "<u4", "total": "<u8", "n1": "<u4", "n2": "<u4"})

    @staticmethod
    def save(folder: str, shard: int, grams: np.ndarray, counts: np.ndarray) -> list[int]:
        """Write a shard's ordered n-grams; its numbers of contexts with one and more followers, of followers and of big counts."""
        first, key = _contexts(grams)
        size = np.diff(np.r_[first, len(grams)])
        single = (size == 1) & (counts[first] < 256)
        own, order = first[single], np.argsort(key[single])
        blocks.Lookup.save(f"{folder}-one", shard, key[single][order], grams[own, -1][order].astype("<u4"), counts[own][order].astype("u1"))
        rest = np.repeat(~single, size)
        words, counts, size, key = grams[rest, -1], counts[rest], size[~single], key[~single]
        at = np.cumsum(size) - size
        sums = [np.add.reduceat(x.astype(np.int64), at) if len(at) else at for x in (counts, counts == 1, counts == 2)]
        order = np.argsort(key)
        columns = (x[order].astype(t) for x, t in zip((at, size, *sums), ("<u8", "<u4", "<u8", "<u4", "<u4"), strict=True))
        blocks.Lookup.save(f"{folder}-many", shard, key[order], *columns)
        big = np.flatnonzero(counts >= 255)
        blocks.put(f"{folder}-next/{shard:06d}", [x.tobytes() for x in (big.astype("<u8"), counts[big].astype("<u8"), words.astype("<u4"), np.minimum(counts, 255).astype("u1"))])
        return [int(single.sum()), len(key), len(words), len(big)]

    def find(self, key: np.ndarray, back: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
        """count of each n-gram (context key[back], word), and its context's total and followers seen 1, 2 and more times."""
        one, many = self.one.find(key), self.many.find(key)
        total, n1, n2 = (np.where(one["found"], x, many[c].astype(np.int64)) for c, x in (("total", one["count"]), ("n1", one["count"] == 1), ("n2", one["count"] == 2)))
        n3 = np.where(one["found"], one["count"] > 2, many["size"].astype(np.int64) - n1 - n2)
        count = np.where(one["found"][back] & (one["word"][back] == word), one["count"][back], 0).astype(np.int64)
        for s, part in blocks.by_shard(np.where(many["found"], blocks.shard_of(key, self.n), -1)[back], self.n):
            _, _, n, n_big = self.sizes[s]
            raw = self.next.get(f"{s:06d}")
            big, large = raw[: 8 * n_big].view("<u8"), raw[8 * n_big : 16 * n_big].view("<u8")
            words, small = raw[16 * n_big : 16 * n_big + 4 * n].view("<u4"), raw[16 * n_big + 4 * n :]
            rounds = np.frexp(many["size"])[1].astype("u1")[back[part]]  # of halving until nothing is left
            by = np.argsort(255 - rounds, kind="stable")
            part, rounds = part[by], rounds[by]
            at, size, goal = many["at"][back[part]].astype(np.int64), many["size"][back[part]].astype(np.int64), word[part]
            lo, end = at.copy(), at + size
            for done in range(int(rounds[0])):
                m = int(np.searchsorted(-rounds.astype(np.int16), -done))  # those with more rounds to go
                half = size[:m] >> 1
                less = (words[np.minimum(lo[:m] + half, n - 1)] < goal[:m]) & (size[:m] > 0)
                lo[:m] += np.where(less, half + 1, 0)
                size[:m] = np.where(less, size[:m] - half - 1, half)
            inside = np.flatnonzero(lo < end)
            inside = inside[words[lo[inside]] == goal[inside]]
            got = small[lo[inside]].astype(np.int64)
            over = np.flatnonzero(got == 255)
            got[over] = large[np.searchsorted(big, lo[inside[over]].astype("u8"))]
            count[part[inside]] = got
        return count, *(x[back].astype(float) for x in (total, n1, n2, n3))


@dataclass
class Level:
    """One order: its n-grams and the discounts for counts of 1, 2 and more."""

    grams: blocks.Lookup | Followers
    discounts: tuple[float, float, float]
    #: Of the empty context (order 1): total and the numbers of words counted once, twice, more often.
    whole: tuple[int, int, int, int]


@dataclass
class Model:
    words: blocks.Lookup
    levels: list[Level] = field(default_factory=list)

    @property
    def n_words(self) -> int:
        return int(self.words.base[-1])

    def log10(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 probability of each token."""
        grams = _grams(ids, counts, len(self.levels))
        p = np.full(len(ids), 1 / (self.n_words + 1))
        for m, level in enumerate(self.levels, 1):
            if m == 1:
                key, back = blocks.grouped(_key(grams[:, -1:]))
                a = level.grams.find(key)["c"].astype(np.int64)[back]
                total, n1, n2, n3 = (np.full(len(ids), float(x)) for x in level.whole)
            else:
                key, back = blocks.grouped(_key(grams[:, -m:-1]))
                a, total, n1, n2, n3 = level.grams.find(key, back, grams[:, -1])
            d1, d2, d3 = level.discounts
            cut = np.array([0, d1, d2, d3])[np.minimum(a, 3)]
            seen = np.maximum(total, 1)
            share = np.where(total > 0, (d1 * n1 + d2 * n2 + d3 * n3) / seen, 1.0)
            p = np.maximum(a - cut, 0) / seen + share * p
        return np.log10(p)


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's, from the numbers of n-grams counted 1 to 4 times; one half of the count where one is missing."""
    n1, n2, n3, n4 = n
    if not (n1 and n2):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return min(max(1 - 2 * y * n2 / n1, 0.05), 1.0), min(max(2 - 3 * y * n3 / n2, 0.05), 2.0), min(max(3 - 4 * y * n4 / n3, 0.05), 3.0) if n3 else 1.5


def train(texts: DataFrame, order: int = 3) -> Model:
    """Count a model of this order over all texts (column text; null: empty) and store it in the shared folder."""
    spark = texts.sparkSession
    folder, n = blocks.shared_dir(spark, "ngrams"), blocks.shards(spark)
    texts = texts.select(F.col("text").cast("string").alias("text"))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, pending = blocks.Words(), blocks.Pending(n)
        for _, raw in blocks.chunks(batches):
            if rows := pending.add(_tokens(raw, cache)[0]):
                yield blocks.payload(rows)
        yield blocks.payload(pending.flush())

    with blocks.shuffles_dropped(spark):
        model = Model(blocks.kept_counts(texts.mapInArrow(words_of, blocks.PAYLOAD), f"{folder}/words", n, 1))

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, held = blocks.Words(), []
        for _, raw in blocks.chunks(batches):
            h, counts = _tokens(raw, cache)
            held.append(_grams(_ranks(h, model.words)[0], counts, order))
            if sum(map(len, held)) > 3_000_000:
                yield blocks.payload(_deal(*_merge(np.concatenate(held), None), n))
                held = []
        if held:
            yield blocks.payload(_deal(*_merge(np.concatenate(held), None), n))

    def level(m: int):
        """Store the n-grams of order m; pass on what order m - 1 counts. Shard -1 has the statistics."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s, parts in blocks.gathered(batches).items():
                grams, times = _merge(*map(np.concatenate, zip(*(_unpacked(x, m) for x in parts), strict=True)))
                if m > 1:
                    sizes = Followers.save(f"{folder}/grams-{m}", s, grams, times)
                    yield blocks.payload(_deal(*_merge(grams[:, 1:], None), n))
                else:
                    key = _key(grams)
                    by = np.argsort(key)
                    blocks.Lookup.save(f"{folder}/grams-1", s, key[by], np.minimum(times[by], 0xFFFFFFFF).astype("<u4"))
                    sizes = [len(key), 0, 0, 0]
                stats = np.array([s, *sizes, int(times.sum()), int((times > 2).sum()), *(int((times == c).sum()) for c in (1, 2, 3, 4))], np.int64)
                yield blocks.payload([(-1, stats.tobytes())])

        return run

    rows = texts.mapInArrow(top, blocks.PAYLOAD)
    for m in range(order, 0, -1):
        with blocks.shuffles_dropped(spark):
            rows = blocks.written(rows.repartitionById(n, "shard").mapInArrow(level(m), blocks.PAYLOAD), f"{folder}/passed-{m}")
        stats = [np.frombuffer(bytes(r.payload), np.int64).tolist() for r in rows.filter("shard = -1").collect()]  # a few numbers for each shard
        rows = rows.filter("shard >= 0")
        sums = np.array([x[5:] for x in stats] or [[0] * 6], np.int64).sum(0).tolist()
        sizes = {x[0]: x[1:5] for x in stats}
        grams = Followers(f"{folder}/grams-{m}", sizes, n) if m > 1 else blocks.Lookup(f"{folder}/grams-1", {s: x[0] for s, x in sizes.items()}, n, {"c": "<u4"})
        model.levels.insert(0, Level(grams, _discounts(sums[2:]), (sums[0], sums[2], sums[3], sums[1])))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, base_score and score (log10 of the text). Null and empty texts have one token, their end."""
    n_train, n_words = model.words.total, model.n_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = blocks.Words()
        for part, raw in blocks.chunks(batches):
            h, counts = _tokens(raw, cache)
            ids, c = _ranks(h, model.words)
            text = np.repeat(np.arange(len(counts)), counts)
            base = np.log10((c + 1.0) / (n_train + n_words + 1.0))
            sums = [np.bincount(text, x, len(counts)) for x in (c > 0, base, model.log10(ids, counts))]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], ["doc_id", "n_tokens", "n_known", "base_score", "score"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCORES)


def held_out(folds: int, fold: int):
    """Whether a row is in the held-out fold, by crc32 of the doc_id's text; a null doc_id never is."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def scored_corpus(docs: DataFrame, order: int = 3, folds: int = 7, fold: int = 2) -> DataFrame:
    """Learn from the rows outside the held-out fold and score all rows."""
    model = train(docs.filter(~held_out(folds, fold)), order)
    return score(docs, model).withColumn("held_out", held_out(folds, fold)).withColumn("train_tokens", F.lit(model.words.total).cast("long"))
