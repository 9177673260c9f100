"""Approximate nearest neighbours by inner product, with a robust-pruned directed graph for each shard.

Vectors are dealt by a hash of their id to shards of ``shard_bytes`` of vectors (16,384 of 64 components).  A larger
value makes fewer shards to search, but one task builds a shard's graph and needs some ten times its bytes; a
node's insertion costs about twice as much in a shard four times as large.  A shard's graph is built by
inserting nodes in growing batches: a greedy beam search over the graph so far proposes neighbours, and
pruning keeps the nearest, then only such that no kept one is much nearer to them (by the factor alpha) than
the node itself; edges back are pruned in the same way.  Inner product becomes distance by one more
component that makes all vectors equally long.  Pruning keeps an edge to one of equal vectors only, so a
shard's graph has each vector once, with the sorted ids of all its copies beside it.

Graphs and vectors are files in the shared folder.  Queries go to every shard: blocks of them are dealt out with a
shard's number, a task maps its shard once and beam-searches it, what was found is scored on the original
vectors, and the best of each shard are ranked under a limit that Spark applies before the exchange too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import blocks

FOUND = "query_id long, mark long, copies long, vec_id long, score double"
#: Bytes of the table of visited nodes for the queries that step together.
VISITED = 1 << 26


def _lengthened(x: np.ndarray) -> np.ndarray:
    """float32 vectors with the component that makes them equally long."""
    square = (x.astype(float) ** 2).sum(1)
    return np.c_[x, np.sqrt(np.maximum(square.max(initial=0) - square, 0))].astype("f4")


def _square(x: np.ndarray) -> np.ndarray:
    return np.einsum("...j,...j->...", x, x)


def beam(x: np.ndarray, near: np.ndarray, q: np.ndarray, starts: np.ndarray, width: int, wide: int = 4) -> np.ndarray:
    """The nodes (-1: none) in the final beams of many queries, which all step together.

    Squared distances are sums over differences: vectors that lie very close keep their order.
    """
    n_q, block = len(q), max(16, VISITED // max(1, len(x)))
    if n_q > block:
        return np.concatenate([beam(x, near, q[a : a + block], starts, width, wide) for a in range(0, n_q, block)])
    ids, dist, done = np.full((n_q, width), -1), np.full((n_q, width), np.inf, "f4"), np.ones((n_q, width), bool)
    seen = np.zeros((n_q, len(x)), bool)
    seen[:, starts] = True
    m = min(len(starts), width)
    ids[:, :m], dist[:, :m], done[:, :m] = starts[:m], _square(q[:, None] - x[starts[:m]]), False
    rows = np.arange(n_q)
    while True:
        open_ = np.where(done[rows], np.inf, dist[rows])
        live = np.isfinite(open_).any(1)
        rows, open_ = rows[live], open_[live]
        if not len(rows):
            return ids
        w = min(wide, width)
        pick = np.argpartition(open_, w - 1, axis=1)[:, :w]
        node = np.where(np.isfinite(np.take_along_axis(open_, pick, 1)), ids[rows[:, None], pick], -1)
        done[rows[:, None], pick] = True
        new = np.where(node[:, :, None] >= 0, near[node], -1).reshape(len(rows), -1)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new[(new >= 0) & seen[rows[:, None], new]] = -1
        r, c = np.nonzero(new >= 0)
        seen[rows[r], new[r, c]] = True
        d = np.full(new.shape, np.inf, "f4")
        d[r, c] = _square(x[new[r, c]] - q[rows[r]])
        all_d, all_i = np.concatenate([dist[rows], d], 1), np.concatenate([ids[rows], new], 1)
        all_done = np.concatenate([done[rows], np.zeros(d.shape, bool)], 1)
        best = np.argpartition(all_d, width - 1, axis=1)[:, :width]
        dist[rows], ids[rows], done[rows] = (np.take_along_axis(a, best, 1) for a in (all_d, all_i, all_done))


def prune(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node at most ``degree`` of its candidates (-1: none)."""
    out = np.full((len(nodes), degree), -1)
    step = max(1, 50_000 // max(1, cand.shape[1]))
    for a in range(0, len(nodes), step):
        p, c = nodes[a : a + step], cand[a : a + step]
        xc = x[c]
        d = _square(xc - x[p][:, None])
        d[(c < 0) | (c == p[:, None])] = np.inf
        r = np.arange(len(p))
        for k in range(degree):
            j = d.argmin(1)
            some = np.isfinite(d[r, j])
            if not some.any():
                break
            out[a : a + step][some, k] = c[r, j][some]
            to = _square(xc - xc[r, j][:, None])
            d[(alpha * alpha * to <= d) | (c == c[r, j][:, None])] = np.inf
    return out


def build(x: np.ndarray, degree: int = 40, width: int = 96, alpha: float = 1.2, batch: int = 1024, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Graph (n, degree) over lengthened vectors and its start nodes; the same input gives the same graph."""
    n = len(x)
    near = np.full((n, degree), -1)
    order = np.random.default_rng(seed).permutation(n)
    middle = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    order = np.r_[middle, order[order != middle]]
    starts, at, size = np.array([middle]), 1, 1
    while at < n:
        nodes = order[at : at + size]
        cand = beam(x, near, x[nodes], starts, width)
        near[nodes] = prune(x, nodes, cand, degree, alpha)
        src, k = np.nonzero(near[nodes] >= 0)
        to, back = near[nodes][src, k], nodes[src]
        by = np.argsort(to, kind="stable")
        to, back = to[by], back[by]
        goal, first, count = np.unique(to, return_index=True, return_counts=True)
        own = (near[goal] >= 0).sum(1)
        some = own + count <= degree
        for g, f, c, o in zip(goal[some].tolist(), first[some].tolist(), count[some].tolist(), own[some].tolist(), strict=True):
            near[g, o : o + c] = back[f : f + c]
        full = np.flatnonzero(~some)
        for part in np.array_split(full[np.argsort(count[full])], max(1, len(full) // 256)):  # of like numbers of new edges
            if len(part):
                cand = np.full((len(part), degree + count[part].max()), -1)
                cand[:, :degree] = near[goal[part]]
                for i, j in enumerate(part.tolist()):
                    cand[i, degree : degree + count[j]] = back[first[j] : first[j] + count[j]]
                near[goal[part]] = prune(x, goal[part], cand, degree, alpha)
        at, size = at + len(nodes), min(2 * size, batch)
    return near, np.unique(np.r_[middle, order[: min(n, 64)]])


class Graph:
    """One shard's files: its different vectors (original and lengthened), their graph and the ids of each.

    Vector i has ids[offsets[i]:offsets[i + 1]], sorted; most[i]: how often one of them is there at most.
    """

    PARTS = (("ids", "i8"), ("offsets", "i8"), ("most", "i4"), ("near", "i4"), ("starts", "i4"), ("vectors", None), ("long", "f4"))

    def __init__(self, folder: str, shard: int, n: int, dim: int, kind: str):
        read = lambda name, t: blocks.mapped(f"{folder}/{dim}-{shard:06d}-{name}").view(t)
        self.ids, self.offsets, self.most, self.starts = read("ids", "i8"), np.array(read("offsets", "i8")), np.array(read("most", "i4")), np.array(read("starts", "i4"))
        self.near, self.vectors, self.long = read("near", "i4").reshape(n, -1), read("vectors", kind).reshape(n, dim), read("long", "f4").reshape(n, dim + 1)

    @staticmethod
    def save(folder: str, shard: int, ids: np.ndarray, vectors: np.ndarray, **options) -> int:
        """Write the files and return the number of different vectors."""
        vectors, of = np.unique(vectors + vectors.dtype.type(0), axis=0, return_inverse=True)  # -0 becomes 0
        of = of.reshape(-1)
        least = np.full(len(vectors), np.iinfo(np.int64).max)
        np.minimum.at(least, of, ids)
        by = np.argsort(least, kind="stable")  # vectors by smallest id
        vectors, of = vectors[by], np.argsort(by)[of]
        order = np.lexsort((ids, of))
        ids, of = ids[order], of[order]
        offsets = np.searchsorted(of, np.arange(len(vectors) + 1))
        first = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (of[1:] != of[:-1])])
        most = np.maximum.reduceat(np.diff(np.r_[first, len(ids)]), np.searchsorted(of[first], np.arange(len(vectors))))
        long = _lengthened(vectors)
        near, starts = build(long, **options)
        for name, x in (("ids", ids.astype("i8")), ("offsets", offsets.astype("i8")), ("most", most.astype("i4")), ("near", near.astype("i4")), ("starts", starts.astype("i4")), ("vectors", vectors), ("long", long)):
            blocks.put(f"{folder}/{vectors.shape[1]}-{shard:06d}-{name}", [np.ascontiguousarray(x).tobytes()])
        return len(vectors)

    def copies(self, node: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each node the smallest ids, at least k without any one id if there are as many; and their number."""
        take = np.minimum(self.offsets[node + 1] - self.offsets[node], k + self.most[node])
        step = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
        return self.ids[np.repeat(self.offsets[node], take) + step], take

    def search(self, q: np.ndarray, width: int) -> np.ndarray:
        """Beams of the queries, which are first made as long as the lengthened vectors: that keeps their order."""
        q = q.astype(float) * np.sqrt(_square(self.long[0].astype(float)) / _square(q.astype(float)))[:, None]
        return beam(self.long, self.near, np.c_[q, np.zeros(len(q))].astype("f4"), self.starts, width)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, dim) without vectors that are null, empty, zero or hold null or non-finite components; no null ids."""
    v = F.col("embedding")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v).filter(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda c: c != 0))
    return rows.select("vec_id", v.alias("v"), F.size(v).alias("dim"))


def _matrix(col: pa.Array, kind: str) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(col), -1)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, shard_bytes: int = 4 << 20, width: int = 192, degree: int = 40, build_width: int = 96, alpha: float = 1.2) -> DataFrame:
    """The k nearest of each query: query_id, rank (from 1), vec_id, score (inner product in double precision).

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows with another vec_id and
    as many components.  Ties go to the smaller vec_id (among what the search found: different vectors with equal
    products, more of them than the beam is wide, may be missed like any other).  Rows that repeat a vec_id are
    candidates each and queries each.  Unusable vectors take no part; without usable ones there are no rows.
    """
    spark = vectors.sparkSession
    folder = blocks.shared_dir(spark, "neighbours")
    rows = usable(vectors)
    kind = "f4" if dict(rows.dtypes)["v"] == "array<float>" else "f8"
    sizes = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row per number of components
    shards = {dim: max(1, -(-n * dim * np.dtype(kind).itemsize // shard_bytes)) for dim, n in sizes.items()}
    n_shards = F.create_map(*(F.lit(x) for d, n in shards.items() for x in (d, n)))[F.col("dim")] if shards else F.lit(1)

    first = dict(zip(shards, np.cumsum([0, *shards.values()]).tolist(), strict=False))
    place = F.create_map(*(F.lit(x) for d, n in first.items() for x in (d, n)))[F.col("dim")] if shards else F.lit(0)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:  # of one shard
            dims, shard, ids = (blocks.column(batch, c) for c in ("dim", "shard", "vec_id"))
            for dim, s in {*zip(dims.tolist(), shard.tolist(), strict=True)}:
                own = np.flatnonzero((dims == dim) & (shard == s))
                of.setdefault((dim, s), []).append((ids[own], _matrix(batch.column(batch.schema.get_field_index("v")).take(pa.array(own)), kind)))
        for (dim, s), parts in of.items():
            n = Graph.save(folder, s, *map(np.concatenate, zip(*parts, strict=True)), degree=degree, width=build_width, alpha=alpha)
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([s], pa.int32()), pa.array([n], pa.int64())], ["dim", "shard", "n"])

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), n_shards).cast("int")).withColumn("task", (place + F.col("shard")).cast("int"))
    made = dealt.repartitionById(max(1, sum(shards.values())), "task").mapInArrow(index, "dim int, shard int, n long")  # a shard for each task
    made = {(r.dim, r.shard): r.n for r in made.collect()}  # a small row for each shard

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, graph = None, None
        for batch in batches:
            names = ("vec_id", "mark", "copies", "dim", "shard")
            ids, marks, copies, dims, shard = (blocks.column(batch, c) for c in names)
            place = dims << 32 | shard
            for a, b in zip(*(lambda cut: (np.r_[0, cut], np.r_[cut, len(place)]))(np.flatnonzero(np.diff(place)) + 1), strict=True):
                dim, s = int(dims[a]), int(shard[a])
                if (dim, s) != now:
                    now, graph = (dim, s), Graph(folder, s, made[dim, s], dim, kind)
                q = _matrix(batch.column(batch.schema.get_field_index("v")).slice(a, b - a), kind)
                at = graph.search(q, min(width, made[now]))
                r, c = np.nonzero(at >= 0)
                node = at[r, c]
                score = np.einsum("ij,ij->i", graph.vectors[node].astype(float), q[r].astype(float))
                found, take = graph.copies(node, k)
                r, score = np.repeat(r, take), np.repeat(score, take)
                some = (found != ids[a + r]) & np.isfinite(score)
                r, found, score = r[some], found[some], score[some]
                order = np.lexsort((found, -score, r))
                order = order[np.arange(len(order)) - np.searchsorted(r[order], r[order]) < k]
                r = a + r[order]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[r], marks[r], copies[r], found[order], score[order])], [x.split()[0] for x in FOUND.split(", ")])

    # equal rows are one query; others with the same id are told apart by their vectors' hash
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id", "dim", "v").agg(F.count("*").alias("copies")).withColumn("mark", F.xxhash64("v"))
    queries = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), n_shards.cast("int") - 1)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(max(1, n // max(1, sum(shards.values())))))
    found = queries.repartition(n, "dim", "shard", block).sortWithinPartitions("dim", "shard").mapInArrow(search, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_")).drop("_")
