"""Decontamination against a plain search."""

import hashlib
import random
import re


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, size=10):
    wins = {(i, tuple(w[k : k + size])) for i, t in items for w in [words(t)] for k in range(max(1, len(w) - size + 1)) if w}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, x in wins:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    found.add(str(i))
        yield (d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))


def test_against_brute_force(spark):
    from tessera.llm.contamination import decontaminate

    rng = random.Random(3)
    word = lambda: rng.choice(["the", "of", "Éa", "x1", "foo", "bar", "Baz", "qu"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([30, 12, 10, 9, 1, 0, 25])] + [(7, None), (8, "zeta eta theta"), (9, "the the the the the the the the the the the")]
    docs = [(100 + k, " - ".join(word() for _ in range(rng.randrange(60)))) for k in range(30)]
    docs += [(1, None), (2, ""), (3, "..."), (4, f"start, {items[0][1].upper()}! end"), (5, items[1][1]), (5, items[1][1]), (6, "ZETA Eta\ntheta"), (None, items[2][1]), (7, "the " * 500)]
    items = [x for x in items if x[0] != 4]  # one word hits nearly all
    got = decontaminate(
        spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, items string"), spark.createDataFrame(items, "item_id long, text string")
    ).drop("items")
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(docs, items), key=key)


def test_a_hot_passage_copies_and_a_null_item(spark):
    """Items that are copies, a document passage in every row, long texts, windows that share shingles."""
    from tessera.llm.contamination import decontaminate

    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(40))
    items = [(i, passage) for i in range(30)] + [(None, "zig zag zog zug zeg " * 6), (50, passage.replace("p20", "q")), (51, "p3 p4 p5 p6")]
    docs = [(i, f"{' '.join(str(rng.random()) for _ in range(3))} {passage if i % 2 else passage[:40]} end") for i in range(60)] + [(99, "zig zag zog zug zeg " * 300), (98, "x " * 20000 + passage)]
    got = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).drop("items")
    rename = [(("" if i is None else i), t) for i, t in items]
    assert sorted(map(tuple, got.collect())) == sorted(brute(docs, rename))


def test_empty_tables(spark):
    from tessera.llm.contamination import decontaminate

    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs, none).select("n_words", "n_hit", "n_items").first() == (3, 0, 0)
    assert decontaminate(docs.limit(0), none).count() == 0
