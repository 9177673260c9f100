"""Spelling variants against plain loops."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import spelling
from tessera.llm.queries import op12_spelling

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def plain(rows):
    """All rows of the result by dictionaries of words with one letter out."""
    n = Counter()
    for doc, text in rows:
        low = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for w in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    words = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    alike, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            alike[w[:i] + "*" + w[i + 1 :]].add(w)
            if (short := w[:i] + w[i + 1 :]) in words:
                near[w].add(short)
                near[short].add(w)
    for group in alike.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min((-words[x], x) for x in near[w]) for w in words if near[w]}
    form = {w: b[1] for w, b in best.items() if -b[0] >= 10 * words[w]}
    out = []
    for w, c in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, c, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


def test_all_words_of_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert sum(r[4] for r in want) > 100 and any(r[1] for r in want)
    assert got(op12_spelling(spark, SF)) == want


def invented(rng, letters, n):
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 12))) for _ in range(n)]
    out = set(base)
    for w in base:
        for _ in range(6):
            i, kind = rng.randrange(len(w)), rng.randrange(3)
            out.add(w[:i] + (rng.choice(letters) if kind else "") + w[i + (kind != 2) :])
    return sorted(out)


@pytest.mark.parametrize("most", [5, 60, 10_000])
def test_cuts_of_the_trie_give_the_same_words(spark, most):
    rng = random.Random(most)
    words = invented(rng, "aeiornztsléÿ", 40) + invented(rng, "kq", 30)  # the latter share few leaves, which are cut by halves
    long = "m" * 2_000
    texts = [" ".join(w for w in words for _ in range(rng.choice([1, 2, 30]))) for _ in range(3)]
    rows = [*enumerate(texts), (3, f"{long} {long} x{long} x{long} {long}y {long}y"), (4, None), (None, "Wortlaut Wortlaut WORTLAUTE wortlaute"), (4, ""), (4, "Wortlaut")]
    rows += [(10 + i, "kqkqkqkq kqkqkqqk kqkqkqqkk") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: spark_lit(i) for i, c in enumerate(("word", "n", "_w", "node"))})
    assert got(spelling.variants(docs, subtree=most)) == plain(rows)


def spark_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_forms_are_followed_to_the_last(spark):
    rows = [(1, " ".join(["letters"] * 4000 + ["letterz"] * 300 + ["lettirz"] * 20 + ["lottirz"] * 2 + ["lettert"] * 300))]
    assert got(spelling.variants(spark.createDataFrame(rows, "doc_id int, text string"))) == plain(rows)
    assert {r[2] for r in plain(rows)} == {"letters"}


def test_very_long_words(spark):
    long = "mn" * 300_000
    rows = [(1, f"{long} {long} x{long} x{long} {long}y {long}y")]
    want = [(long, None, long, 2, 2, None), (f"{long}y", None, f"{long}y", 2, 1, None), (f"x{long}", None, f"x{long}", 2, 1, None)]
    assert not any(zlib.crc32(f"1:{w[0]}".encode()) % 31 == 0 for w in want)
    assert got(spelling.variants(spark.createDataFrame(rows, "doc_id int, text string"))) == want


def test_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert got(spelling.variants(empty)) == []
    assert got(spelling.variants(spark.createDataFrame([(1, "once only words"), (2, None)], "doc_id long, text string"))) == []


def test_near_words_of_a_subtree():
    rng = random.Random(4)
    words = [w.encode("latin-1") for w in invented(rng, "aeiornsé", 50)]

    def one_edit(a, b):
        a, b = sorted((a, b), key=len)
        return a != b and any(b[:i] + b[i + 1 :] == (a if len(a) < len(b) else a[:i] + a[i + 1 :]) for i in range(len(b)))

    tree, own = spelling.Subtree(words, np.ones(len(words), np.int64)), spelling.Spelt(words)
    found = [tuple(sorted((own.words[i], tree.spelt.words[j]))) for i, j in zip(*(x.tolist() for x in tree.near(own, 0)), strict=True)]
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}
