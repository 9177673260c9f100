"""The factorization machine: interactions, held-out accuracy and odd rows."""

import math
import random
import re
import zlib

import numpy as np
import xxhash


def plain_terms(text):
    out = set()
    for w in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))):
        out |= {w} | {b"^" + w[:n] for n in (3, 4, 6) if len(w) > n}
    return out


def plain_score(machine, text):
    place = {int(h): i for i, h in enumerate(machine.terms)}
    own = sorted({place[h] for t in plain_terms(text) if (h := xxhash.xxh3_64_intdigest(t)) in place})
    z = machine.bias + sum(machine.weight[i] for i in own)
    for a in range(len(own)):
        for b in range(a):
            z += float(machine.factors[own[a]] @ machine.factors[own[b]]) / len(own)
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def plain_selection(rows, far=5.0):
    """rows: (text, label). Hashes of the terms that take part, where they are few."""
    p, n, df, pos = sum(y for _, y in rows), len(rows), {}, {}
    for text, y in rows:
        for t in plain_terms(text):
            df[t], pos[t] = df.get(t, 0) + 1, pos.get(t, 0) + y
    off = {t: abs(pos[t] - d * p / n) / math.sqrt(d * p / n * (1 - p / n)) for t, d in df.items() if d >= 3}
    return sorted(xxhash.xxh3_64_intdigest(t) for t, x in off.items() if x >= far)


def test_learns_a_pair_that_weights_alone_miss():
    from tessera.llm.toxicity import Machine, fit

    rng = np.random.default_rng(0)
    x = rng.random((2000, 12)) < 0.4
    y = (x[:, 0] ^ x[:, 1]).astype(float)  # no additive score separates this
    rows, cols = np.nonzero(x)
    w, v, b = fit(rows, cols, y, 12)
    score = Machine(np.arange(12).astype("u8"), w, v, b).score(rows, cols, len(y))
    assert ((score > 0.5) == y).mean() > 0.97


def test_held_out_accuracy_and_odd_rows(spark):
    from tessera.llm.toxicity import toxicity, train

    rng = random.Random(2)
    docs, labels = [], []
    for i in range(1500):
        words, bad = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 30, 300]))], rng.random() < 0.15
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["Scum,", "moron!", "LOSER"]))
        docs.append((i, " ".join(words), "a"))
        labels.append((i, int(bad), 1))
    extra = [(None, "scum"), (5000, None), (5001, ""), (5002, "moron " * 20000)]
    d = spark.createDataFrame([*docs, *((i, t, "a") for i, t in extra)], "doc_id long, text string, score string")
    m = train(d, spark.createDataFrame([*labels, (None, 1, 1), (3, None, 1), (7, 0, 1)], "doc_id long, toxic int, text int"))
    marked = {i: y for i, y, _ in labels if zlib.crc32(str(i).encode()) % 4 != 2}
    assert m.terms.tolist() == plain_selection([(t, marked[i]) for i, t, _ in docs if i in marked])
    got = {r.doc_id: r for r in toxicity(d, m).collect()}
    assert len(got) == len(docs) + len(extra)
    held = [i for i, y, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i in held) and sum(r.held_out for r in got.values()) == len(held) + sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in (5000, 5001, 5002))
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.98
    assert got[5002].predicted == 1 and got[5001].score == got[5000].score < 0.3
    for i, t, _ in [*docs, *((i, t, "a") for i, t in extra)]:
        assert abs(got[i].score - plain_score(m, t)) < 1e-9


def test_a_pair_counts_in_long_texts(spark):
    """Neither an insult nor a group is toxic alone; both together are, among many other words."""
    from tessera.llm.toxicity import toxicity, train

    rng = random.Random(4)
    docs, labels = [], []
    for i in range(3000):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.choice([5, 40, 120]))]
        a, b = rng.random() < 0.35, rng.random() < 0.35
        words += ["insult"] * a + ["group"] * b
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(a and b)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    m = train(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity(d, m).collect()}
    held = [i for i, _ in labels if got[i].held_out]
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.98


def test_repeated_ids_and_no_term_far_enough(spark):
    from tessera.llm.toxicity import toxicity, train

    d = spark.createDataFrame([(1, "scum"), (1, "scum"), (3, "fine"), (3, None)], "doc_id long, text string")
    m = train(d, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int"))
    assert not len(m.terms) and {r.score for r in toxicity(d, m).collect()} == {0.5} and toxicity(d, m).count() == 4


def test_one_class_and_empty_tables(spark):
    from tessera.llm.toxicity import toxicity, train

    d = spark.createDataFrame([(1, "a b"), (3, "c")], "doc_id long, text string")
    for rows in ([], [(1, 0), (3, 0)]):
        m = train(d, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert all(0 <= r.score <= 1 for r in toxicity(d, m).collect())
    assert toxicity(d.limit(0), m).count() == 0
