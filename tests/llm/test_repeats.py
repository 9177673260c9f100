"""Repeat removal against a plain count of all windows."""

import random
import re
from collections import Counter


def brute(docs, length):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + length]) for w in split for i in range(len(w) - length + 1))
    for (d, _), w in zip(docs, split, strict=True):
        gone = {j for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for j in range(i, i + length)}
        yield d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)


def check(spark, docs, **more):
    from tessera.llm.repeats import remove_repeats

    got = remove_repeats(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, kept int"), **more)
    key = lambda r: tuple(str(x) for x in r)
    rows = got.collect()
    assert sorted([tuple(r[:4]) for r in rows], key=key) == sorted(brute(docs, more.get("length", 35)), key=key)
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in rows)


def test_against_brute_force(spark):
    rng = random.Random(5)
    text = lambda n, k: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    shared = text(50, 1000)
    docs = [(i, f"{text(rng.randrange(80), 1000)}\n{shared}\t{text(20, 1000)}") for i in range(5)]
    docs += [(10, None), (11, ""), (12, "same " * 100), (13, "a b c " * 30), (14, text(35, 9)), (14, text(34, 9)), (None, shared[:-3]), (15, shared + " é x " + shared)]
    docs += [(20 + i, text(200, 3)) for i in range(6)]
    check(spark, docs)
    check(spark, docs, length=9, seed=4)
    check(spark, docs[:3], length=12, seed=12)


def test_empty_table(spark):
    from tessera.llm.repeats import remove_repeats

    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
