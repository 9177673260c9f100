"""Graph search against brute force."""

import numpy as np


def brute(ids, x, k, every):
    s = x.astype(float) @ x.astype(float).T
    for i in np.flatnonzero(ids % every == 0):
        c = np.flatnonzero(ids != ids[i])
        c = c[np.lexsort((ids[c], -s[i, c]))][:k]
        yield int(ids[i]), list(zip(ids[c].tolist(), s[i, c].tolist(), strict=True))


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v], 1) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, rank int")


def test_recall_and_scores(spark):
    from tessera.llm.neighbours import nearest

    rng = np.random.default_rng(6)
    centre = rng.normal(size=(10, 24))
    x = np.r_[centre[rng.integers(0, 10, 1500)] + 0.4 * rng.normal(size=(1500, 24)), centre[:1] + 1e-3 * rng.normal(size=(700, 24)), rng.normal(size=(300, 24)) * 3].astype("f4")
    ids = rng.permutation(len(x))
    got, hit, n = {}, 0, 0
    for r in nearest(frame(spark, ids, x), shard_bytes=800 * 4 * x.shape[1]).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q, want in brute(ids, x, 20, 20):
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 21)) and q not in [v for _, v, _ in own]
        s = {i: float(x[ids == i][0].astype(float) @ x[ids == q][0].astype(float)) for _, i, _ in own}
        assert all(abs(s[v] - sc) < 1e-9 for _, v, sc in own)
        hit, n = hit + len({v for _, v, _ in own} & {v for v, _ in want}), n + 20
    assert hit / n > 0.92, hit / n


def test_odd_rows(spark):
    from tessera.llm.neighbours import nearest

    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (20, None), (40, [0.0, 0.0]), (60, [float("nan"), 1.0]), (80, [1.0, None]), (3, [float("inf"), 1.0]), (None, [1.0, 1.0]), (100, [2.0]), (5, [-1.0, 0.0]), (5, [0.5, 0.5]), (-20, [0.0, 1.0])]
    got = sorted(tuple(r) for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    zero = [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 5, 0.5), (0, 4, -20, 0.0), (0, 5, 5, -1.0)]
    assert [g for g in got if g[0] == 0] == zero
    assert [g[2] for g in got if g[0] == -20] == [5, 0, 1, 2, 5] and {g[0] for g in got} == {0, -20}
    twice = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (7, [2.0, 1.0])]
    got = sorted(tuple(r) for r in nearest(spark.createDataFrame(twice, "vec_id long, embedding array<double>")).collect())
    assert got == [(0, 1, 7, 1.0), (0, 1, 7, 2.0), (0, 1, 7, 2.0)]
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_many_exact_copies(spark):
    """Every query in or near a large group of copies gets the smallest ids of it."""
    from tessera.llm.neighbours import nearest

    rng = np.random.default_rng(8)
    one = rng.normal(size=(1, 16))
    x = np.r_[np.repeat(one, 900, 0), one + 0.05 * rng.normal(size=(100, 16)), rng.normal(size=(1400, 16))]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("f4")
    ids = rng.permutation(len(x))
    got = {}
    for r in nearest(frame(spark, ids, x), shard_bytes=800 * 4 * x.shape[1]).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    copies = set(ids[:900].tolist())
    n = 0
    for q, want in brute(ids, x, 20, 20):
        if q in copies:
            n += 1
            assert [v for _, v in sorted(got[q])] == sorted(copies - {q})[:20]
    assert n > 20
