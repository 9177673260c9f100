"""The stored model against a dictionary version of modified Kneser-Ney."""

import math
import random
import re
from collections import Counter, defaultdict


def tokens(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "\n"]


class Plain:
    def __init__(self, texts, order):
        split = [tokens(t) for t in texts]
        self.order, self.words = order, Counter(w for s in split for w in s)
        count = Counter(tuple((["<s>"] * (order - 1) + s)[i : i + order]) for s in split for i in range(len(s)))
        self.levels = {}
        for m in range(order, 0, -1):
            n = [sum(c == k for c in count.values()) for k in (1, 2, 3, 4)]
            if n[0] and n[1]:
                y = n[0] / (n[0] + 2 * n[1])
                d = [min(max(1 - 2 * y * n[1] / n[0], 0.05), 1), min(max(2 - 3 * y * n[2] / n[1], 0.05), 2), min(max(3 - 4 * y * n[3] / n[2], 0.05), 3) if n[2] else 1.5]
            else:
                d = [0.5, 1.0, 1.5]
            after = defaultdict(list)
            for g, c in count.items():
                after[g[:-1]].append(c)
            self.levels[m] = (count, after, d)
            count = Counter(g[1:] for g in count)

    def p(self, gram):
        if not gram:
            return 1 / (len(self.words) + 1)
        count, after, d = self.levels[len(gram)]
        lower, own = self.p(gram[1:]), after.get(gram[:-1])
        if not own:
            return lower
        c, total = count.get(gram, 0), sum(own)
        cut = d[min(c, 3) - 1] if c else 0
        return max(c - cut, 0) / total + sum(d[min(x, 3) - 1] for x in own) / total * lower

    def score(self, t):
        s = ["<s>"] * (self.order - 1) + tokens(t)
        return sum(math.log10(self.p(tuple(w if w in self.words or w == "<s>" else "<new>" for w in s[i : i + self.order]))) for i in range(len(s) - self.order + 1))


def test_against_dictionaries(spark):
    from tessera.llm.ngrams import score, train

    rng = random.Random(8)
    texts = [" ".join(rng.choice(["The", "cat", "sat", "on", "a", "mat", "é", "dog"]) for _ in range(rng.randrange(30))) for _ in range(60)] + [None, "", "cat " * 3000]
    frame = lambda rows: spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    ask = [*enumerate(texts), (500, "a NEW word\ton the mat"), (None, "cat"), (500, "zzz")]
    for order in (1, 2, 3):
        model, plain = train(frame(enumerate(texts)), order), Plain(texts, order)
        n = sum(plain.words.values())
        assert model.words.total == n and model.n_words == len(plain.words)
        got = sorted(map(tuple, score(frame(ask), model).collect()), key=str)
        want = sorted(((i, len(tokens(t)), sum(w in plain.words for w in tokens(t)), sum(math.log10((plain.words[w] + 1) / (n + len(plain.words) + 1)) for w in tokens(t)), plain.score(t)) for i, t in ask), key=str)
        for g, w in zip(got, want, strict=True):
            assert g[:3] == w[:3] and abs(g[3] - w[3]) < 1e-6 * max(1, abs(w[3])) and abs(g[4] - w[4]) < 1e-6 * max(1, abs(w[4]))


def test_empty_training(spark):
    from tessera.llm.ngrams import scored_corpus

    none = spark.createDataFrame([], "doc_id long, text string")
    assert scored_corpus(none).count() == 0
    held = spark.createDataFrame([(i, "a b") for i in range(60)], "doc_id long, text string")
    rows = scored_corpus(held).collect()
    assert any(r.held_out for r in rows) and all(r.n_tokens == 3 and r.score < 0 for r in rows)


def test_registered_query_sees_two_words_back(spark, tmp_path):
    """After 'b', only the word before it says whether 'x' or 'y' comes: a bigram model scores both texts alike."""
    from tessera.llm.queries import op2_lm_scoring

    rows = [(i, "a b x" if i % 2 else "c b y") for i in range(200)] + [(1000 + i, t) for i, t in enumerate(("a b x", "a b y"))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in op2_lm_scoring(spark, str(tmp_path)).collect()}
    assert got[1000] - got[1001] > 1
