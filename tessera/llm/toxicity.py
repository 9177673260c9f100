"""Toxicity scores from a factorization machine over hashed terms.

A text is the set of its terms: words and their beginnings, hashed to 64 bits.  The machine's score is a bias,
a weight for each term and, for each pair of terms in a text, the product of their factors, so that a pair
such as an insult and a group's name can weigh more than both alone.  Pairs are divided by the number of the
text's terms (that is, factors see terms of unit length), so that the many pairs of a long text do not drown
the few that count.  Terms whose counts in the training rows' classes lie ``far`` standard deviations from
chance take part, the ``features`` farthest at most; they are chosen in Spark from all terms of these rows.

The model is fitted by one task on at most about ``most`` labelled rows (a documented bound: more rows are
thinned by a hash of their id); what the driver holds is the fitted model of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import blocks


@dataclass(frozen=True)
class Machine:
    """terms (sorted hashes), weight and factors of each, and the bias."""

    terms: np.ndarray
    weight: np.ndarray
    factors: np.ndarray
    bias: float

    def score(self, rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
        """Probability of each of n texts; (rows, cols) are its distinct terms."""
        length = np.maximum(np.bincount(rows, minlength=n), 1)
        z = np.zeros(n)
        for f in range(self.factors.shape[1]):
            v = self.factors[cols, f]
            z += 0.5 * (np.bincount(rows, v, n) ** 2 - np.bincount(rows, v * v, n))
        z = self.bias + np.bincount(rows, self.weight[cols], n) + z / length
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Fit:
    """Weights, then weights and factors, by mini-batch AdaGrad on log loss.

    A fifth of the texts is kept aside in each phase: it stops when their loss has not fallen for four rounds and
    goes back to the best.  The same input gives the same model.
    """

    def __init__(self, rows: np.ndarray, cols: np.ndarray, label: np.ndarray, size: int, k: int = 8, batch: int = 128, rate: float = 0.1, l2: float = 1e-3, l2_factors: float = 2e-3, seed: int = 7):
        self.rng, self.label, self.k, self.batch, self.rate, self.l2, self.l2_factors = np.random.default_rng(seed), label, k, batch, rate, l2, l2_factors
        n = len(label)
        self.cols, self.start = cols[np.argsort(rows, kind="stable")], np.searchsorted(np.sort(rows), np.arange(n + 1))
        aside = self.rng.permutation(n) % 5 == 0
        self.train, self.aside = np.flatnonzero(~aside), np.flatnonzero(aside)
        self.w, self.v, self.b = np.zeros(size), self.rng.normal(0, 0.05, (size, k)), float(np.log((label.sum() + 1) / (n - label.sum() + 1)))
        self.seen_w, self.seen_v = np.full(size, 1e-6), np.full((size, k), 1e-6)

    def terms(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the text among these, term) pairs."""
        count = self.start[texts + 1] - self.start[texts]
        at = np.arange(count.sum()) + np.repeat(self.start[texts] - np.r_[0, np.cumsum(count)[:-1]], count)
        return np.repeat(np.arange(len(texts)), count), self.cols[at]

    def forward(self, texts: np.ndarray, pairs: bool) -> tuple[np.ndarray, ...]:
        """Scores before the logistic function, and what the gradient needs."""
        r, c = self.terms(texts)
        z, scaled, total = self.b + np.bincount(r, self.w[c], len(texts)), None, None
        scale = 1 / np.sqrt(np.maximum(np.bincount(r, minlength=len(texts)), 1))
        if pairs:
            scaled = self.v[c] * scale[r][:, None]
            total = np.stack([np.bincount(r, x, len(texts)) for x in scaled.T], 1)
            z = z + 0.5 * ((total**2).sum(1) - np.bincount(r, (scaled**2).sum(1), len(texts)))
        return r, c, z, scale, scaled, total

    def loss(self, pairs: bool) -> float:
        z, y = self.forward(self.aside, pairs)[2], self.label[self.aside]
        return float(np.mean(np.logaddexp(0, z) - y * z)) if len(y) else 0.0

    def step(self, texts: np.ndarray, pairs: bool) -> None:
        r, c, z, scale, scaled, total = self.forward(texts, pairs)
        e, share = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - self.label[texts]) / len(texts), len(texts) / len(self.label)
        seen, back = np.unique(c, return_inverse=True)
        d = np.bincount(back, e[r], len(seen)) + self.l2 * share * self.w[seen]
        self.seen_w[seen] += d**2
        self.w[seen] -= self.rate * d / np.sqrt(self.seen_w[seen])
        if pairs:
            each = (e * scale)[r][:, None] * (total[r] - scaled)
            d = np.stack([np.bincount(back, x, len(seen)) for x in each.T], 1) + self.l2_factors * share * self.v[seen]
            self.seen_v[seen] += d**2
            self.v[seen] -= self.rate * d / np.sqrt(self.seen_v[seen])
        self.b -= 0.05 * float(e.sum())

    def phase(self, pairs: bool, rounds: int, patience: int = 4) -> None:
        best, late = (self.loss(pairs), self.w.copy(), self.v.copy(), self.b), 0
        for _ in range(rounds):
            for texts in np.array_split(self.rng.permutation(self.train), max(1, len(self.train) // self.batch)):
                self.step(texts, pairs)
            now = self.loss(pairs)
            if now < best[0] - 1e-5:
                best, late = (now, self.w.copy(), self.v.copy(), self.b), 0
            elif (late := late + 1) >= patience:
                break
        _, self.w, self.v, self.b = best


def fit(rows: np.ndarray, cols: np.ndarray, label: np.ndarray, size: int, rounds: tuple[int, int] = (20, 60), **options) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, factors and bias for the (text, distinct term) pairs and the texts' labels (0 or 1)."""
    machine = Fit(rows, cols, label, size, **options)
    machine.phase(False, rounds[0])
    machine.phase(True, rounds[1])
    return machine.w, machine.v, machine.b


#: Bytes of the word beginnings that are terms beside the word: they meet inflected and compound forms.
STARTS = (3, 4, 6)


def hashes(word: bytes) -> list[int]:
    """A word's terms; a word that is shorter than a beginning stands for it."""
    return [xxhash.xxh3_64_intdigest(x) for x in (word, *(b"^" + word[:n] if len(word) > n else word for n in STARTS))]


class Terms(blocks.Words):
    """word -> the hashes of its terms, 8 bytes each."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > blocks.CACHE_WORDS // 2:
            self.clear()
        got = self[word] = b"".join(x.to_bytes(8, "little") for x in hashes(word))
        return got


class Chosen(blocks.Words):
    """word -> the places of its terms among those of a model, 4 bytes each; most words have none."""

    def __init__(self, terms: np.ndarray):
        self.place = {x: i.to_bytes(4, "little") for i, x in enumerate(terms.tolist())}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > blocks.CACHE_WORDS:
            self.clear()
        got = self[word] = b"".join(self.place.get(x, b"") for x in hashes(word))
        return got


def words(raw: bytes) -> set[bytes]:
    return set(raw.translate(blocks.ALNUM).split())


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def train(docs: DataFrame, labels: DataFrame, features: int = 4096, most: int = 20_000, far: float = 5.0, folds: int = 4, held: int = 2) -> Machine:
    """Fit on labelled rows outside the held-out fold (crc32 of the doc_id's text).

    A document with several labels is toxic if one says so; null labels and ids don't count; rows that repeat a
    doc_id are a text each.  Without both classes in the training rows or without a term far enough from
    chance, the model has no terms and scores the rate (0.5 without any row).
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    marks = marks.filter(F.crc32(F.col("doc_id").cast("string")) % folds != held).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marks.count()
    if n > most:
        marks = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * most / n))
    # at most about `most` rows of two numbers, by the bound above
    rows = _texts(docs).join(F.broadcast(marks), "doc_id").select("doc_id", "toxic", "text")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Terms()
        for part, raw in blocks.chunks(batches):
            sets = [np.unique(np.frombuffer(b"".join(map(cache.__getitem__, words(x))), "i8")) for x in raw]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "toxic", "terms"])

    folder = blocks.shared_dir(docs.sparkSession, "toxicity")
    made = blocks.written(rows.mapInArrow(terms, "doc_id long, toxic int, terms array<long>"), f"{folder}/terms")
    totals = made.agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).first()
    p, n = float(totals.p or 0), float(totals.n)
    none = Machine(np.empty(0, "u8"), np.empty(0), np.empty((0, 1)), float(np.log((p + 1) / (n - p + 1))))
    if not p or p == n:
        return none
    # how far the term's document counts in the two classes are from what chance gives, in standard deviations
    by_term = made.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum("toxic").alias("pos")).filter("df >= 3")
    off = F.abs(F.col("pos") - F.col("df") * (p / n)) / F.sqrt(F.col("df") * (p / n) * (1 - p / n))
    best = by_term.filter(off >= far).orderBy(off.desc(), "term").limit(features).select("term").collect()
    picked = np.sort(np.array([r.term for r in best], "i8").view("u8"))  # `features` numbers at most
    if not len(picked):
        return none

    def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(2)
            h, counts = col.flatten().to_numpy(zero_copy_only=False).view("u8"), col.value_lengths().to_numpy(zero_copy_only=False)
            at = np.searchsorted(picked, h)
            at[at == len(picked)] = 0
            some = picked[at] == h
            ends = np.searchsorted(np.repeat(np.arange(len(counts)), counts)[some], np.arange(len(counts) + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[some], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["doc_id", "toxic", "at"])

    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["doc_id"], r["at"]))
        counts = [len(r["at"]) for r in got]
        cols = np.array([x for r in got for x in r["at"]], np.int64)
        w, v, b = fit(np.repeat(np.arange(len(got)), counts), cols, np.array([r["toxic"] for r in got], float), len(picked))
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()]), pa.array([v.tobytes()]), pa.array([b])], ["w", "v", "b"])

    # the fit alone is one task, over the bounded sample
    one = made.mapInArrow(slim, "doc_id long, toxic int, at array<int>").repartition(1).mapInArrow(model, "w binary, v binary, b double").first()
    return Machine(picked, np.frombuffer(one.w), np.frombuffer(one.v).reshape(len(picked), -1), one.b)


def with_scores(docs: DataFrame, machine: Machine, name: str = "score") -> DataFrame:
    """docs (text as string and any others) with the score of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Chosen(machine.terms)
        for part, raw in blocks.chunks(batches):
            sets = [b"".join(map(cache.__getitem__, words(x))) for x in raw] if len(machine.terms) else [b""] * len(raw)
            size = max(1, len(machine.terms))
            pair = np.unique(np.repeat(np.arange(len(sets)), [len(x) // 4 for x in sets]) * size + np.frombuffer(b"".join(sets), "<u4"))
            score = machine.score(pair // size, pair % size, len(sets))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def toxicity(docs: DataFrame, machine: Machine, threshold: float = 0.3, folds: int = 4, held: int = 2) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. Null and empty texts get the score of no terms; a null doc_id is not held out."""
    out = with_scores(_texts(docs), machine).drop("text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
