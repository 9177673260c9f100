"""Jaccard groups against all pairs."""

import random
import re


def shingles(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs, percent=75):
    own, up = [shingles(t) for _, t in docs], {d: d for d, _ in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(own):
        for j in range(i):
            b = own[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(docs[i][0]), root(docs[j][0])
                up[max(x, y)] = min(x, y)
    return sorted((d, len(s), root(d)) for (d, _), s in zip(docs, own, strict=True))


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: [f"W{rng.randrange(300)}" for _ in range(n)]
    passage, docs = text(60), [None, "", "  ", "one", "ONE", "one two three", "a b c d e"]
    for _ in range(12):
        base = text(rng.choice([5, 20, 60, 200]))
        docs.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            near = list(base)
            for _ in range(rng.randrange(1 + len(base) // 15)):
                near[rng.randrange(len(near))] = f"x{rng.randrange(50)}"
            docs.append("\n".join(near))
    docs += [" ".join(passage + text(rng.randrange(30))) for _ in range(30)]
    docs += [docs[8]] * 5 + ["repeat " * 2000]
    rng.shuffle(docs)
    return list(enumerate(docs, 10))


def test_against_all_pairs(spark):
    from tessera.llm.similarity import similar_groups

    for seed in (1, 2):
        docs = corpus(seed)
        for block in (8192, 4):
            got = similar_groups(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n int"), block=block)
            assert sorted(map(tuple, got.collect())) == brute(docs)


def test_repeated_and_null_ids(spark):
    from tessera.llm.similarity import similar_groups

    docs = [(5, "a b c d e f"), (5, "u v w x y z"), (3, "u v w x y z"), (9, "a b c d e f"), (None, "q r s t u"), (1, "q r s t u")]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(5, 2, 3), (3, 2, 3), (9, 2, 3), (None, 1, None), (1, 1, None)}


def test_empty_table(spark):
    from tessera.llm.similarity import similar_groups

    assert similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_with_heavy_centres(spark, tmp_path):
    from tessera.llm.graphs import components

    rng = random.Random(7)
    edges = [(0, i) for i in range(1, 200)] + [(500, i) for i in range(501, 560)] + [(199, 500)] + [(i, i + 1) for i in range(1000, 1040)] + [(rng.randrange(2000, 2060), rng.randrange(2000, 2060)) for _ in range(30)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    want = {x: root(x) for e in edges if e[0] != e[1] for x in e}
    for heavy in (20, 100_000):
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), f"file://{tmp_path}/{heavy}", heavy).collect()}
        assert got == want
