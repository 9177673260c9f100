"""Personal data by weak supervision, in DataFrame functions only.

Base patterns give spans that always stay.  Looser patterns propose more candidates (secrets after a key
name, bare keys, telephone numbers without a country code, spelt-out mail addresses).  Five labelers vote on
every candidate with yes, no or abstain: a strict regex, a gazetteer, the words before it, its neighbours and
a check of its content.  Expectation-maximisation on the counts of vote patterns estimates the labelers'
reliabilities and the chance that a candidate is personal data; with these chances as soft targets, a
logistic classifier over the candidate's features is trained, and it decides on the candidates that are not
base spans.

Vote patterns and feature cells are categorical: there are at most a few thousand, whatever the corpus.  Only
their counts reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import blocks

#: Base patterns, written so that every search is linear in the text (possessive repeats; a
#: match starts at the start of its run of characters or where the last match ended).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
EXTRA = {
    "email_like": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]++)++",
    "key": r"(?<![A-Za-z0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])",
    "phone_like": r"(?<![0-9+.() -])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])",
    "secret": r"(?i)(?<![a-z])(?:token|password|passwd|secret|api[_-]?key|access[_-]?key)[ ]?[=:][ ]?[\"']?[a-z0-9+/_-]{12,}+",
}
KINDS = [*BASE, *EXTRA]
#: Characters without which a pattern cannot match.
NEEDS = {"email": ["@"], "phone": ["+"], "email_like": ["[at]", "(at)"], "ip": ["."], "secret": ["=", ":"]}
#: Strict form of each kind.
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}$",
    "ip": r"^([0-9]{1,3}\.){3}[0-9]{1,3}$",
    "card": r"^[0-9]{4}([ -]?[0-9]{4}){3}[0-9]{0,3}$",
    "phone": r"^\+[1-9][0-9]{0,3}[ .-]?\(?[0-9]{2,4}\)?([ .-]?[0-9]{2,4}){1,4}$",
    "email_like": r"[A-Za-z]{2,}$",
    "key": r"[0-9].*[a-f]|[a-f].*[0-9]",
    "phone_like": r"^(\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[.-])[0-9]{3}[.-][0-9]{4}$",
    "secret": r"[0-9]",
}
#: Gazetteers: what a match of the kind may hold, and what speaks against it.
KNOWN = {
    "email": (r"(?i)\.(com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$", r"(?i)@(localhost|example|test)$"),
    "ip": (r"^([1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\.", r"^(0|10|127|192\.168|169\.254|255)\."),
    "card": (r"^(4|5[1-5]|2[2-7]|3[47]|6)", r"^([0178]|9)"),
    "phone": (r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])", r"^\+0"),
    "email_like": (r"(?i)(com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$", r"^$"),
    "key": (r"^([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})$", r"^(.)\1+$"),
    "phone_like": (r"^\(?[2-9][0-8][0-9]", r"^\(?[01]"),
    "secret": (r"(?i)^(token|password|passwd|secret|api.?key|access.?key)", r"(?i)(xxxx|example|changeme|your)"),
}
CUES = r"(?i)(e-?mail|mail|contact|call|phone|tel|fax|mobile|ip|host|address|card|visa|credit|iban|token|password|passwd|secret|key|login|user|correo|telefon|adresse|tarjeta|carte)"
AGAINST = r"(?i)(version|release|isbn|doi|order|invoice|page|figure|chapter|commit|checksum|sha|md5)\W*$"
VOTES = ["regex", "gazetteer", "context", "neighbours", "content"]
SPAN = "struct<kind:string,start:bigint,end:bigint,match:string,before:string,after:string>"


def _scan(values: Column, step, width: int = 256) -> Column:
    """Running sums, maxima or the like (step of two longs) of an array of longs from 0 on.

    By blocks, so that an array is never copied for each of its elements.
    """
    none, zero = F.array().cast("array<bigint>"), F.lit(0).cast("bigint")

    def fold(a: Column, first: Column) -> Column:
        add = lambda acc, x: F.struct(step(acc.s, x).alias("s"), F.concat(acc["all"], F.array(step(acc.s, x))).alias("all"))
        return F.aggregate(a, F.struct(first.alias("s"), none.alias("all")), add, lambda acc: acc["all"])

    def run(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(width)), lambda a: F.slice(v, a, width))
        firsts = F.concat(F.array(zero), fold(F.transform(parts, lambda p: F.aggregate(p, zero, step)), zero))
        return F.flatten(F.transform(F.arrays_zip(parts.alias("p"), firsts.alias("s")), lambda z: F.when(z["p"].isNotNull(), fold(z["p"], z["s"])).otherwise(none)))

    return F.get(F.transform(F.array(values), run), F.lit(0))  # the lambda's variable: values are computed once


def _sums(values: Column) -> Column:
    return _scan(values, lambda a, x: a + x)


def _tops(values: Column) -> Column:
    return _scan(values, lambda a, x: F.greatest(a, x))


def _before(running: Column) -> Column:
    """What a running value was before each element."""
    return F.concat(F.array(F.lit(0).cast("bigint")), F.slice(running, F.lit(1), F.greatest(F.size(running) - 1, F.lit(0))))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _content(kind: str, m: Column) -> Column:
    """What the contract's drop rules and their likes say of a match."""
    d = _digits(m)
    if kind == "ip":
        small = lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False)
        return F.forall(F.split(F.regexp_replace(m, r"(^|\.)0+(?=[0-9])", "$1"), r"\."), small)
    if kind == "card":
        return F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(d).between(8, 15)
    if kind == "phone_like":
        return F.length(d) == 10
    if kind in ("key", "secret"):
        return F.size(F.array_distinct(F.split(F.lower(F.regexp_extract(m, r"([A-Za-z0-9+/_-]+)$", 1)), ""))) >= 8
    return F.length(m) <= 254


def _found(steps: DataFrame, kind: str, name) -> DataFrame:
    """Add the column of a kind's matches, in place; each regex runs once for the gaps and once for the matches."""
    rx, text, m, g, e = (BASE | EXTRA)[kind], F.col(name("t")), name("m"), name("g"), name("e")
    may = F.lit(True)
    if kind in NEEDS:
        may = F.lit(False)
        for x in NEEDS[kind]:
            may = may | F.contains(text, F.lit(x))
    if kind in ("ip", "card", "phone_like", "key"):
        may = may & F.col(name("digits"))
    none = F.array().cast("array<string>")
    steps = steps.withColumn(m, F.when(may, F.regexp_extract_all(text, F.lit(rx), F.lit(0))).otherwise(none))
    steps = steps.withColumn(g, F.when(F.size(m) > 0, F.split(text, rx, -1)).otherwise(none))
    sizes = F.zip_with(F.slice(g, 1, F.size(m)), m, lambda x, y: (F.length(x) + F.length(y)).cast("bigint"))
    steps = steps.withColumn(e, F.when(F.size(m) > 0, _sums(sizes)).otherwise(F.array().cast("array<bigint>")))
    z = F.arrays_zip(F.col(m).alias("m"), F.col(e).alias("e"), F.slice(g, 1, F.size(m)).alias("b"), F.transform(F.slice(g, 2, F.size(m) + 1), lambda x: F.left(x, F.lit(1))).alias("a"))
    spans = F.transform(z, lambda s: F.struct(
        F.lit(kind).alias("kind"), (s["e"] - F.length(s["m"])).alias("start"), s["e"].alias("end"), s["m"].alias("match"), F.right(s["b"], F.lit(40)).alias("before"), s["a"].alias("after"),
    ))
    if kind in BASE and kind != "email":
        spans = F.filter(spans, lambda s: _content(kind, s["match"]))
    return steps.withColumn(name(kind), spans.cast(f"array<{SPAN}>")).drop(m, g, e)


def _kept(steps: DataFrame, base: str, more: str, name) -> DataFrame:
    """Of the candidates in ``more`` those that neither overlap a base span nor lie in a longer candidate.

    Two sweeps over sorted places, each with a running maximum; no span is compared with all others.
    """
    long = lambda c: c.cast("bigint")
    places, tops, order, wide = name("places"), name("tops"), name("order"), name("wide")
    # base spans by their start; a candidate stands where it ends, before base spans that start there
    steps = steps.withColumn(places, F.array_sort(F.concat(
        F.transform(base, lambda b: F.struct(b.start.alias("at"), F.lit(1).alias("base"), b.end.alias("end"), F.lit(-1).alias("i"))),
        F.transform(more, lambda x, i: F.struct(x.end.alias("at"), F.lit(0).alias("base"), long(F.lit(0)).alias("end"), i.alias("i"))),
    )))
    steps = steps.withColumn(tops, _tops(F.transform(places, lambda p: p["end"])))
    steps = steps.withColumn(places, F.filter(F.zip_with(places, tops, lambda p, t: F.struct(p["i"].alias("i"), t.alias("top"))), lambda p: p["i"] >= 0))
    # candidates by start, longer ones first; the running maximum is of (end, -start) in one number
    shift = long(F.lit(1 << 31))
    steps = steps.withColumn(order, F.array_sort(F.transform(more, lambda x, i: F.struct(x.start.alias("start"), (-x.end).alias("end"), i.alias("i")))))
    steps = steps.withColumn(wide, _before(_tops(F.transform(order, lambda o: -o["end"] * shift + (shift - 1 - o["start"])))))
    steps = steps.withColumn(order, F.zip_with(order, wide, lambda o, w: F.struct(o["i"].alias("i"), (w > -o["end"] * shift + (shift - 1 - o["start"])).alias("inner"))))
    marks = F.zip_with(F.array_sort(places), F.array_sort(order), lambda p, o: F.struct(p["top"].alias("top"), o["inner"].alias("inner")))
    clear = F.filter(F.zip_with(more, marks, lambda x, k: F.struct(x.alias("x"), k.alias("k"))), lambda z: (z["k"]["top"] <= z["x"]["start"]) & ~z["k"]["inner"])
    return steps.withColumn(more, F.transform(clear, lambda z: z["x"])).drop(places, tops, order, wide)


def candidates(docs: DataFrame, base: str = "base", extra: str = "extra") -> DataFrame:
    """docs with ``base`` (spans that stay) and ``extra`` (candidates that neither overlap them nor lie in a longer one), each in order of kind and start.

    Null and empty texts have no spans. The two names must not be columns of docs; no other name is touched.
    """
    name = lambda x: blocks.unused([*docs.columns, base, extra], f"_{x}")
    out = docs.withColumn(name("t"), F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn(name("digits"), F.rlike(name("t"), F.lit("[0-9]")))
    for kind in KINDS:
        out = _found(out, kind, name)
    out = out.withColumn(base, F.concat(*(F.col(name(k)) for k in BASE))).withColumn(extra, F.concat(*(F.col(name(k)) for k in EXTRA)))
    return _kept(out, base, extra, name).drop(name("t"), name("digits"), *(name(k) for k in KINDS))


def _by_kind(kind: Column, make) -> Column:
    out = F.lit(None)
    for k in reversed(KINDS):
        out = F.when(kind == k, make(k)).otherwise(out)
    return out


def votes(s: Column) -> list[Column]:
    """The labelers' votes (1, 0 or null) on a span, in the order of VOTES."""
    rl = lambda c, rx: F.rlike(c, F.lit(rx))
    glued = rl(F.right(s["before"], F.lit(1)), "[A-Za-z0-9]") | rl(F.coalesce(s["after"], F.lit("")), "[A-Za-z0-9]")
    return [
        _by_kind(s["kind"], lambda k: rl(s["match"], STRICT[k])).cast("int"),
        _by_kind(s["kind"], lambda k: F.when(rl(s["match"], KNOWN[k][1]), 0).when(rl(s["match"], KNOWN[k][0]), 1)).cast("int"),
        F.when(rl(s["before"], AGAINST), 0).when(rl(s["before"], CUES), 1).cast("int"),
        F.when(glued, 0).otherwise(1).cast("int"),
        _by_kind(s["kind"], lambda k: _content(k, s["match"])).cast("int"),
    ]


def features(s: Column) -> list[Column]:
    """Categorical features of a span, as text: kind, length, share of digits and its neighbours, and the votes."""
    size = F.length(s["match"])
    share = F.floor(4 * F.length(_digits(s["match"])) / F.greatest(size, F.lit(1)))
    near = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "none").when(F.rlike(c, F.lit("[A-Za-z0-9]")), "word").when(F.rlike(c, F.lit(r"\s")), "blank").otherwise("mark")
    own = [F.concat(F.lit("kind="), s["kind"]), F.concat(F.lit("size="), F.least(F.floor(size / 8), F.lit(8)).cast("string")), F.concat(F.lit("digits="), share.cast("string")),
           F.concat(F.lit("left="), near(F.right(s["before"], F.lit(1)))), F.concat(F.lit("right="), near(s["after"]))]
    return own + [F.concat(F.lit(f"{n}="), F.coalesce(v.cast("string"), F.lit("-"))) for n, v in zip(VOTES, votes(s), strict=True)]


@dataclass(frozen=True)
class Labels:
    """What EM found: the chance of personal data by kind, and of a right vote by labeler and true class."""

    prior: dict[str, float]
    right: list[tuple[float, float]]

    def chance(self, kind: str, pattern: tuple) -> float:
        yes = no = 0.0
        p = self.prior.get(kind, 0.5)
        yes, no = math.log(p), math.log(1 - p)
        for v, (pos, neg) in zip(pattern, self.right, strict=True):
            if v is not None:
                yes += math.log(pos if v else 1 - pos)
                no += math.log(1 - neg if v else neg)
        return 1 / (1 + math.exp(max(-50.0, min(50.0, no - yes))))


def estimate(counts: list[tuple[str, tuple, int]], rounds: int = 40) -> Labels:
    """EM for (kind, vote pattern, count): reliabilities that make the observed votes most likely."""
    kinds, n_votes = sorted({k for k, _, _ in counts}), len(VOTES)
    labels = Labels(dict.fromkeys(kinds, 0.6), [(0.8, 0.8)] * n_votes)
    for _ in range(rounds):
        soft = [(k, pat, n, labels.chance(k, pat)) for k, pat, n in counts]
        total = {k: [1.0, 2.0] for k in kinds}
        seen = [[[4.0, 5.0], [4.0, 5.0]] for _ in range(n_votes)]  # right and all, smoothed
        for k, pat, n, p in soft:
            total[k][0] += n * p
            total[k][1] += n
            for j, v in enumerate(pat):
                if v is not None:
                    seen[j][0][0] += n * p * v
                    seen[j][0][1] += n * p
                    seen[j][1][0] += n * (1 - p) * (1 - v)
                    seen[j][1][1] += n * (1 - p)
        clip = lambda x: min(max(x, 0.02), 0.98)
        labels = Labels({k: clip(a / b) for k, (a, b) in total.items()}, [(clip(y[0] / y[1]), clip(z[0] / z[1])) for y, z in seen])
    return labels


def logistic(cells: list[tuple[list[str], float, float]], rounds: int = 300, rate: float = 0.5, l2: float = 1e-3) -> dict[str, float]:
    """Weights of features (and '' for the bias) from (features, count, sum of soft labels)."""
    w: dict[str, float] = {"": 0.0} | {f: 0.0 for fs, _, _ in cells for f in fs}
    total = sum(n for _, n, _ in cells) or 1.0
    for _ in range(rounds):
        step = {f: -l2 * x for f, x in w.items()}
        for fs, n, y in cells:
            z = w[""] + sum(w[f] for f in fs)
            e = (y - n / (1 + math.exp(-max(-50.0, min(50.0, z))))) / total
            for f in ("", *fs):
                step[f] += e
        for f, d in step.items():
            w[f] += rate * d
    return w


def fit(found: DataFrame, base: str = "base", extra: str = "extra") -> tuple[Labels, dict[str, float]]:
    """EM and then the classifier, from a frame with base and extra. Without candidates, nothing is accepted."""
    spans = found.select(F.explode(F.concat(base, extra)).alias("s"))
    # at most (kinds) x 3^5 patterns times the feature cells of five small categories
    cells = spans.select(F.col("s.kind").alias("kind"), F.array(*features(F.col("s"))).alias("f"), F.array(*votes(F.col("s"))).alias("v")).groupBy("kind", "v", "f").count().collect()
    by_pattern: dict[tuple, int] = {}
    for r in cells:
        by_pattern[r.kind, tuple(r.v)] = by_pattern.get((r.kind, tuple(r.v)), 0) + r["count"]
    labels = estimate(sorted(((k, v, n) for (k, v), n in by_pattern.items()), key=str))
    soft = sorted(((list(r.f), float(r["count"]), r["count"] * labels.chance(r.kind, tuple(r.v))) for r in cells), key=lambda x: x[0])
    return labels, logistic(soft)


def accepted(weights: dict[str, float], base: str = "base", extra: str = "extra") -> Column:
    """All spans of a row with base and extra that stay, in order of kind and start."""
    table = F.create_map(*(x for f, w in sorted(weights.items()) for x in (F.lit(f), F.lit(float(w)))))
    score = lambda s: F.aggregate(F.array(*features(s)), F.lit(float(weights[""])), lambda a, f: a + F.coalesce(table[f], F.lit(0.0)))
    more = F.when(F.size(extra) > 0, F.filter(extra, lambda s: score(s) >= 0)).otherwise(F.col(extra))
    return F.concat(base, more)


def find_pii(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, base and spans (arrays of kind, start, end, match, before, after; code points, end exclusive).

    Null and empty texts have no spans; rows that repeat a doc_id each give a row.
    """
    folder = blocks.shared_dir(docs.sparkSession, "pii")
    found = candidates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text")
    found = blocks.written(found, f"{folder}/candidates")
    return found.select("doc_id", "base", accepted(fit(found)[1]).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of its text replaced by its kind in brackets, and n_chars (if there) of the new text.

    Spans that overlap are replaced as one, under the kind of the first and longest. Texts without spans stay as
    they are, null ones too. What was found is written to the shared folder, so texts are scanned once.
    """
    base, extra, spans, tops, ends, wide = (blocks.unused(docs.columns, f"_{x}") for x in ("base", "extra", "spans", "tops", "ends", "wide"))
    found = blocks.written(candidates(docs, base, extra), f"{blocks.shared_dir(docs.sparkSession, 'pii')}/found")
    some = found.withColumn(spans, F.array_sort(F.transform(accepted(fit(found, base, extra)[1], base, extra), lambda s: F.struct(s.start.alias("start"), (-s.end).alias("end"), s.kind.alias("kind")))))
    some = some.withColumn(tops, _tops(F.transform(spans, lambda s: -s["end"])))
    # the first span of each run that overlaps, and where the run before it ended
    heads = F.zip_with(spans, _before(F.col(tops)), lambda s, t: F.struct(s["start"].alias("start"), t.alias("from"), s["kind"].alias("kind")))
    some = some.withColumn(spans, F.filter(heads, lambda h: h["start"] >= h["from"]))
    # by code points: four bytes each, so that a piece is cut out without walking through the text before it
    some = some.withColumn(wide, F.encode(F.col("text").cast("string"), "UTF-32"))
    cut = lambda a, n: F.decode(F.substring(F.col(wide), (4 * a + 1).cast("int"), (4 * n).cast("int")), "UTF-32")
    pieces = F.transform(spans, lambda h: F.concat(cut(h["from"], h["start"] - h["from"]), F.lit("["), F.upper(h["kind"]), F.lit("]")))
    last = F.array_max(tops)
    whole = F.concat(F.array_join(pieces, ""), cut(last, F.length(F.col(wide)) / 4 - last))
    out = some.withColumn("text", F.when(F.size(spans) > 0, whole).otherwise(F.col("text")).cast(docs.schema["text"].dataType))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
