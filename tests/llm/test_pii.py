"""Personal data: base spans against plain regexes, EM and the classifier on planted cases."""

import hashlib
import random
import re

EMAIL, IP, CARD, PHONE = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(t):
    only = lambda m: re.sub("[^0-9]", "", m[0])
    good = {
        "email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m[0].split(".")),
        "card": lambda m: 16 <= len(only(m)) <= 19 and luhn(only(m)), "phone": lambda m: 8 <= len(only(m)) <= 15,
    }
    return [(k, m.start(), m.end()) for k, rx in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)) for m in re.finditer(rx, t or "") if good[k](m)]


def texts():
    rng = random.Random(9)
    bits = ["a@b.co", "x.y+z@mail.example.com", "1.2.3.4", "01.002.3.255", "256.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (863) 555-1234", "+12", ".5.6.7", "_q@r.s", "é", "😀", " ", " ", "\n", "12", "-", "word", ",", "@", "+", "1.2.3.4.5.6.7.8", "4532015112830366"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(400)]
    return [*out, None, "", "9" * 30000, "1 " * 20000, "a." * 20000 + "@", "a@b.c " * 3000]


def test_base_spans_and_offsets(spark):
    from tessera.llm.pii import find_pii, summary

    rows = list(enumerate(texts())) + [(None, "a@b.co"), (0, "a@b.co")]
    got = summary(find_pii(spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, base string"))).collect()
    want = []
    for d, t in rows:
        own = base(t)
        want.append((d, *(sum(k == x for k, _, _ in own) for x in ("email", "ip", "card", "phone")), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in own).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r[:6])) for r in got)
    assert all(set(",".join(f"{k}:{a}:{b}" for k, a, b in base(t)).split(",")) <= set(s.split(",")) | {""} for (_, t), s in [(r, next(g.spans for g in got if g.doc_id == r[0])) for r in rows[1:300]])


def test_estimates_reliabilities():
    from tessera.llm.pii import estimate

    rng, true, counts = random.Random(3), [(0.95, 0.9), (0.7, 0.8), (0.6, 0.6), (0.9, 0.7), (0.85, 0.95)], {}
    for _ in range(20000):
        y = rng.random() < 0.4
        pat = tuple(None if rng.random() < 0.1 else int(rng.random() < (p if y else 1 - n)) for p, n in true)
        counts[pat] = counts.get(pat, 0) + 1
    got = estimate([("secret", k, n) for k, n in sorted(counts.items(), key=str)], 200)
    assert abs(got.prior["secret"] - 0.4) < 0.04
    assert all(abs(a - b) < 0.05 for x, y in zip(got.right, true, strict=True) for a, b in zip(x, y, strict=True))


def plain_em(counts, rounds=40):
    """counts: (kind, votes, n). The chance of each row being personal data, by the rules of the docstring, row by row."""
    kinds = {k for k, _, _ in counts}
    prior, right = dict.fromkeys(kinds, 0.6), [[0.8, 0.8] for _ in range(5)]

    def chance(k, votes):
        yes, no = prior[k], 1 - prior[k]
        for v, (a, b) in zip(votes, right, strict=True):
            if v is not None:
                yes, no = yes * (a if v else 1 - a), no * (1 - b if v else b)
        return yes / (yes + no)

    clip = lambda x: min(max(x, 0.02), 0.98)
    for _ in range(rounds):
        soft = [chance(k, v) for k, v, _ in counts]
        new = {k: clip((1 + sum(n * p for (j, _, n), p in zip(counts, soft, strict=True) if j == k)) / (2 + sum(n for j, _, n in counts if j == k))) for k in kinds}
        for i in range(5):
            own = [(v[i], n, p) for (_, v, n), p in zip(counts, soft, strict=True) if v[i] is not None]
            right[i] = [clip((4 + sum(n * p * v for v, n, p in own)) / (5 + sum(n * p for _, n, p in own))), clip((4 + sum(n * (1 - p) * (1 - v) for v, n, p in own)) / (5 + sum(n * (1 - p) for _, n, p in own)))]
        prior = new
    return [chance(k, v) for k, v, _ in counts]


def plain_logistic(cells, rounds=300):
    """cells: (features, n, soft label sum); gradient steps of 0.5 on the mean log loss with l2 of 0.001."""
    import numpy as np

    names = sorted({f for fs, _, _ in cells for f in fs})
    x = np.array([[1.0, *(float(f in fs) for f in names)] for fs, _, _ in cells])
    n, y, w = np.array([c[1] for c in cells]), np.array([c[2] for c in cells]), np.zeros(len(names) + 1)
    for _ in range(rounds):
        w += 0.5 * (x.T @ (y - n / (1 + np.exp(-x @ w))) / n.sum() - 1e-3 * w)
    return dict(zip(["", *names], w, strict=True))


def test_estimates_and_decisions_against_plain_versions(spark):
    from pyspark.sql import functions as F

    from tessera.llm.pii import candidates, estimate, features, find_pii, fit, votes

    rng = random.Random(6)
    hex_ = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = [f"{rng.choice(['token =', 'commit', 'secret:', 'sha', 'api_key='])} {hex_(rng.choice([14, 32, 40, 50, 300]))} call 555{rng.choice('.-')}123-{rng.randrange(1000, 9999)} mail a{i} [at] b.com, x@y.org" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = candidates(df)
    rows = found.select("doc_id", F.explode(F.concat("base", "extra")).alias("s")).select("doc_id", "s", F.array(*votes(F.col("s"))).alias("v"), F.array(*features(F.col("s"))).alias("f")).collect()
    cells = {}
    for r in rows:
        cells[r.s.kind, tuple(r.v), tuple(r.f)] = cells.get((r.s.kind, tuple(r.v), tuple(r.f)), 0) + 1
    pats = {}
    for (k, v, _), n in cells.items():
        pats[k, v] = pats.get((k, v), 0) + n
    counts = sorted(((k, v, n) for (k, v), n in pats.items()), key=str)
    labels, chances = estimate(counts), plain_em(counts)
    assert all(abs(labels.chance(k, v) - p) < 1e-6 for (k, v, _), p in zip(counts, chances, strict=True))
    by_pattern = {(k, v): p for (k, v, _), p in zip(counts, chances, strict=True)}
    w = plain_logistic([(f, n, n * by_pattern[k, v]) for (k, v, f), n in cells.items()])
    got = fit(found)[1]
    assert set(got) == set(w) and all(abs(got[f] - w[f]) < 1e-6 for f in w)
    base_kinds = ("email", "ip", "card", "phone")
    want = {(r.doc_id, r.s.kind, r.s.start, r.s.end) for r in rows if r.s.kind in base_kinds or w[""] + sum(w[f] for f in r.f) >= 0}
    assert {(r.doc_id, s.kind, s.start, s.end) for r in find_pii(df).collect() for s in r.spans} == want
    assert any(e - a > 250 for _, k, a, e in want if k == "secret")


def test_candidates_against_all_pairs(spark):
    """Sweeps choose the same candidates as comparing every span with every other."""
    from tessera.llm import pii

    rng = random.Random(11)
    span = lambda k: (k, a := rng.randrange(60), a + rng.randrange(1, 12), "m", "", "")
    rows = [(i, [span("email") for _ in range(rng.randrange(6))], [span(rng.choice(["key", "secret"])) for _ in range(rng.randrange(12))]) for i in range(400)]
    df = spark.createDataFrame(rows, f"doc_id long, b array<{pii.SPAN}>, x array<{pii.SPAN}>")
    got = {r.doc_id: [tuple(s) for s in r.x] for r in pii._kept(df, "b", "x", lambda c: f"_{c}").collect()}
    for i, b, x in rows:
        clear = [s for s in x if not any(y[1] < s[2] and s[1] < y[2] for y in b)]
        assert got[i] == [s for s in clear if not any(y[1] <= s[1] and y[2] >= s[2] and y[2] - y[1] > s[2] - s[1] for y in x)]


def test_adds_secrets_and_redacts(spark):
    from tessera.llm.pii import find_pii, redacted

    rng = random.Random(4)
    hex_ = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    docs = [(i, f'say token = "{hex_(40)}" and mail me.{i}@mail.com then', 1, "b", "e") for i in range(60)] + [(100 + i, f"password={hex_(18)} é😀 10.20.30.{i}", 1, "b", "e") for i in range(60)]
    docs += [(900, "token = aaaaaaaaaaaaaaaaaaaa", 1, "b", "e"), (901, None, None, "b", None), (None, "clean text, no numbers", 22, None, "e"), (3, docs[3][1], 1, "twice", "e")]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars long, base string, _t string").withColumn("extra", F_lit())
    got = {r.doc_id: r for r in find_pii(df).collect()}
    assert [[s.kind for s in got[i].spans] for i in range(60)] == [["email", "secret"]] * 60
    assert not got[None].spans and not got[901].spans
    made = redacted(df)
    assert made.columns == df.columns and made.count() == len(docs)
    out = {(r.doc_id, r.base): r for r in made.collect()}
    assert out[3, "b"].text == out[3, "twice"].text == 'say [SECRET]" and mail [EMAIL] then' and out[3, "b"].n_chars == len(out[3, "b"].text)
    assert out[101, "b"].text == "[SECRET] é😀 [IP]" and out[None, None].text == "clean text, no numbers" and out[901, "b"].text is None and out[None, None].n_chars == 22
    assert all(r._t == "e" or r.doc_id == 901 for r in out.values()) and {r.extra for r in out.values()} == {"kept"}


def F_lit():
    from pyspark.sql import functions as F

    return F.lit("kept")


def test_many_spans_in_one_text(spark):
    """Spans are not compared with all others: tens of thousands in one text take seconds."""
    import time

    from tessera.llm.pii import redacted

    rng = random.Random(5)
    text = " ".join(f"token={rng.randrange(16**20):020x} and u{i}@mail.com" for i in range(16000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    out = redacted(df).first().text
    assert out.count("[EMAIL]") == 16000 and out.count("[SECRET]") > 15900 and time.time() - began < 60


def test_empty_table(spark):
    from tessera.llm.pii import find_pii, redacted, summary

    none = spark.createDataFrame([], "doc_id long, text string")
    assert summary(find_pii(none)).count() == redacted(none).count() == 0
