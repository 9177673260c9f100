"""Whitening of embeddings: principal components by Golub-Kahan-Lanczos bidiagonalisation over distributed rows.

With X the centred rows, each step multiplies them by a right vector (Xv, one number a row) and the result back
(X'u, one number a dimension).  A left vector is as long as the table, but it is X times a vector of the dimensions,
so only the latter is kept; every pass computes the earlier left vectors again, block by block, and adds up the
products with them.  So one pass gives the next pair, made orthogonal to all earlier ones on both sides.  The small
upper bidiagonal matrix has the same singular values as X: its right vectors turn the kept ones into components,
its values over sqrt(n) are the deviations.

Passes go on until the leading components stand still to about a unit in the last place, or the dimensions are used
up; where a direction ends early (repeated eigenvalues, fewer directions than dimensions) a new one is begun that
is orthogonal to all others, so no copy of an eigenvalue is missed.  The driver holds vectors of the dimensions
only; sums come from tasks as one row for each entry.

Rows whose vector is null or has null or non-finite entries take no part.  The dimension is the most frequent length
among the others (the larger of equals); rows of another one take no part either.  Components are those with an
eigenvalue over 1e-13 of the trace: no rows, one row or equal rows give none and so no result.  Rows that repeat a
vec_id count each.  Entries are cut to +-2**40 before they are made whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import blocks

OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
BLOCK = 4096
#: Rank limit: an eigenvalue of less than this share of the trace is rounding.
NOTHING = 1e-13


def fit_rows(vectors: DataFrame, id_col: str, vec_col: str, folder: str) -> tuple[DataFrame, int]:
    """(ids, x) blocks of the remaining rows, x as long numbers row by row, stored in the shared folder; and the dimension."""
    vec = F.col(vec_col)
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec, lambda c: c.cast("double")).alias("vec"))
    good = good.filter(F.col("vec").isNotNull() & F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    sizes = good.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).filter("d > 0")
    top = sizes.agg(F.max_by("d", F.struct("n", "d"))).first()[0]
    if top is None:
        return good.limit(0).select(F.lit(b"").alias("ids"), F.lit(b"").alias("x")), 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = blocks.column(batch, "vec_id")
            c = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, top)
            x = np.floor(np.clip(c * 1024, -(2.0**40), 2.0**40)).astype(np.int64) + 100_000
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            starts = range(0, len(x), BLOCK)
            parts = [[v[a : a + BLOCK].tobytes() for a in starts] for v in (np.where(null, np.iinfo(np.int64).min, ids), x)]
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.binary()) for p in parts], ["ids", "x"])

    rows = good.filter(F.size("vec") == top).mapInArrow(run, "ids binary, x binary")
    return blocks.written(rows, f"{folder}/rows"), top


class Rows:
    """The stored rows: sums over all of them of what a function makes of each centred block."""

    def __init__(self, stored: DataFrame, dims: int):
        self.stored, self.dims = stored, dims
        self.n, self.sums = 0, np.zeros(dims, np.int64)
        total = self._added(lambda x: np.r_[len(x), x.sum(0)], np.int64, "long")
        if len(total):
            self.n, self.sums = int(total[0]), total[1:]

    def _added(self, f: Callable[[np.ndarray], np.ndarray], kind: type, ddl: str) -> np.ndarray:
        dims = self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for raw in batch.column(1).to_pylist():
                    got = f(np.frombuffer(raw, np.int64).reshape(-1, dims)).astype(kind)
                    total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "value"])

        rows = self.stored.mapInArrow(run, f"i int, value {ddl}").groupBy("i").agg(F.sum("value").alias("value")).collect()  # one row for each entry
        out = np.zeros(len(rows), kind)
        for r in rows:
            out[r.i] = r.value
        return out

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the numerator is a whole number, so nothing is lost before the division."""
        return (x * self.n - self.sums) / self.n

    def added(self, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        n, sums = self.n, self.sums
        return self._added(lambda x: f((x * n - sums) / n), np.float64, "double")


def _orthogonal(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        v = v - basis.T @ (basis @ v)
    return v


def _fresh(basis: np.ndarray, dims: int) -> np.ndarray:
    """A unit vector orthogonal to the basis, the same in every run."""
    rng = np.random.default_rng(len(basis))
    v = _orthogonal(rng.standard_normal(dims), basis)
    return v / np.linalg.norm(v)


def bidiagonalised(rows: Rows, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(components as rows, eigenvalues of the covariance), falling, ``wanted`` at most.

    Step k has a right vector v and a left one u = X a.  With w = X v and U the earlier left vectors, a pass adds up
    U'w, w'w and X'w; what U'w holds is taken off a, and X'u follows from X'w and the earlier X'u.
    """
    d = rows.dims
    v, right, left, back = _fresh(np.zeros((0, d)), d), np.zeros((0, d)), np.zeros((0, d)), np.zeros((0, d))
    coupling: list[np.ndarray] = []  # U'X v of each step: the columns of the small matrix, upper bidiagonal but for rounding
    scale = kept = None
    for step in range(d):

        def products(x: np.ndarray, v: np.ndarray = v, left: np.ndarray = left) -> np.ndarray:
            w = x @ v
            return np.r_[(x @ left.T).T @ w, w @ w, x.T @ w]

        total = rows.added(products)
        across, norm2, product = total[:step], total[step], total[step + 1 :]
        a, size2 = v - left.T @ across, norm2 - across @ across
        scale = max(scale or 0.0, math.sqrt(max(norm2, 0.0)))
        right = np.vstack([right, v])
        size = math.sqrt(size2) if size2 > (1e-13 * scale) ** 2 and size2 > 1e-20 * norm2 else 0.0
        coupling.append(np.r_[across, size])
        # a direction without a length of its own keeps its place with a left vector of zeros
        left = np.vstack([left, a / size if size else np.zeros(d)])
        back = np.vstack([back, (product - back.T @ across) / size if size else np.zeros(d)])
        small = np.zeros((step + 1, step + 1))
        for k, column in enumerate(coupling):
            small[: k + 1, k] = column
        u, sigma, vt = np.linalg.svd(small)
        rest = _orthogonal(back[-1], right)
        beta = float(np.linalg.norm(rest))
        # what the next step would change: beta times the last entries of the left vectors
        moved = beta * np.abs(u[-1, :wanted])
        still = step + 1 >= min(d, wanted + 2) and (moved <= 1e-15 * sigma[:wanted]).all()
        if step + 1 == d or (still and kept):
            break
        kept = still  # once more from a fresh direction: a repeated eigenvalue shows itself
        v = rest / beta if beta > 1e-13 * scale and not still else _fresh(right, d)
    lead = vt[:wanted] @ right
    value = sigma[:wanted] ** 2 / rows.n
    return lead, value


def polished(rows: Rows, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Rotate components so that their own covariance is diagonal; eigenvalues from it, and the trace: one pass."""
    k = len(lead)

    def products(x: np.ndarray) -> np.ndarray:
        y = x @ lead.T
        return np.r_[(y.T @ y).ravel(), (x * x).sum()]

    total = rows.added(products) / rows.n
    cov, trace = total[:-1].reshape(k, k), float(total[-1])
    value, turn = np.linalg.eigh((cov + cov.T) / 2)
    return turn[:, ::-1].T @ lead, value[::-1], trace


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row for each remaining vector and leading component; see the module.

    deviation is the sum over dimensions of (n x - S)**2, null where it doesn't fit a long; whitened the centred
    vector's product with the component over the square root of its eigenvalue; explained the eigenvalue's share
    of the trace; identity_error the largest entry of the whitened values' covariance minus the identity.
    """
    spark = vectors.sparkSession
    folder = blocks.shared_dir(spark, "whitening")
    nothing = spark.createDataFrame([], OUT)
    stored, dims = fit_rows(vectors, id_col, vec_col, folder)
    if not dims:
        return nothing
    rows = Rows(stored, dims)
    lead, value, trace = polished(rows, bidiagonalised(rows, min(components, dims))[0])
    real = value > NOTHING * trace
    lead, value = lead[real], value[real]
    if not len(value):
        return nothing
    scaled = lead / np.sqrt(value)[:, None]
    k, n, sums = len(value), rows.n, rows.sums

    def seconds(x: np.ndarray) -> np.ndarray:
        y = x @ scaled.T
        return np.r_[y.sum(0), (y.T @ y).ravel()]

    total = rows.added(seconds) / n
    error = float(np.abs(total[k:].reshape(k, k) - np.outer(total[:k], total[:k]) - np.eye(k)).max())
    share = value / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                vec_id, x = np.frombuffer(ids, np.int64), np.frombuffer(raw, np.int64).reshape(-1, dims)
                off = x * n - sums
                y = (off / n) @ scaled.T
                m = len(x)
                cols = [
                    pa.array(np.repeat(vec_id, k), mask=np.repeat(vec_id == np.iinfo(np.int64).min, k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    pa.array(np.repeat(np.array(_squares(off), object), k), pa.int64()), pa.array(y.ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in OUT.split(", ")])

    return stored.mapInArrow(run, OUT)


def _squares(off: np.ndarray) -> list[int | None]:
    """Exact sums of squares of each row, None where they pass a long."""
    if np.abs(off).max(initial=0) < math.isqrt((1 << 63) // max(off.shape[1], 1)):
        return (off * off).sum(1).tolist()
    sums = [sum(v * v for v in row) for row in off.tolist()]
    return [s if s < 1 << 63 else None for s in sums]
