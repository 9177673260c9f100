"""Licence scans against a plain version."""

import math
import random
import re
from collections import Counter


def brute(docs, least=0.75, whole=0.5):
    from tessera.llm.licences import TEMPLATES, WORD, weights

    idf, vectors = weights(TEMPLATES)
    rows = []
    for d, t, lang, source in docs:
        best, marked = (0.0, None), 0
        for line in (t or "").split("\n"):
            w = re.findall(WORD, line.lower())
            v = {x: c * idf.get(x, math.log(1 + len(vectors)) + 1) for x, c in Counter(w).items()}
            size = math.sqrt(sum(x * x for x in v.values())) or 1
            top = max(((round(sum(v.get(x, 0) * y for x, y in u.items()) / size, 6), k) for k, u in sorted(vectors.items())), key=lambda x: x[0])
            if top[0] > best[0]:
                best = top
            marked += len(w) if top[0] >= least else 0
        own = best[1] if best[0] >= least else None
        path = f"/{source or '_'}/{lang or '_'}/{d // 100}/{d}.txt"
        rows.append([d, path, own, own is not None and marked >= whole * len((t or "").split())])
    files = {}
    for _, p, lic, f in sorted(rows, key=lambda r: r[1]):
        if f:
            files.setdefault(p.rsplit("/", 1)[0], lic)
    for d, p, lic, f in rows:
        at, eff, src = p.rsplit("/", 1)[0], lic, None
        while lic is None and at:
            if at in files:
                eff, src = files[at], at
                break
            at = at.rsplit("/", 1)[0]
        yield d, p, lic, f, eff, src


def test_against_plain_version(spark):
    from tessera.llm.licences import TEMPLATES, scan

    rng, notes = random.Random(1), list(TEMPLATES.values())
    docs = []
    for i in range(400):
        body = " ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([0, 2, 40])))
        text = body + ("\n" + rng.choice(notes).upper() if rng.random() < 0.1 else "") + ("\n the license version of this work" if rng.random() < 0.2 else "")
        docs.append((i * 7, text, rng.choice(["en", None, "a/b"]), f"s{rng.randrange(3)}"))
    docs += [(5, None, "en", "s0"), (6, "", "en", "s0"), (7, notes[0] + " " + "word " * 50000, "de", "s1")]
    docs = [(d, t, l and l.replace("/", "_"), s) for d, t, l, s in docs]
    got = {r.doc_id: (r.doc_id, r.path, r.licence, r.is_file, r.effective, r.from_dir) for r in scan(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, lang string, source string, path string")).collect()}
    want = {r[0]: r for r in brute(docs)}
    assert got == want and sum(r[5] is not None for r in want.values()) > 20


def test_empty_table(spark):
    from tessera.llm.licences import scan

    assert scan(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_real_licence_texts(spark):
    """Whole licence files, wrapped and commented headers, inline notices, titles and tags, none of them from the test tables."""
    import os
    import textwrap

    from tessera.llm.licences import HEADERS, full_texts, own_licence

    filler = " ".join(f"word{i}" for i in range(300))
    headers = {}
    for k, t in HEADERS:
        headers[k] = max(headers.get(k, ""), t, key=len)
    commented = lambda t, w, mark: "\n".join(f"{mark} {x}" for x in textwrap.wrap(t, w))
    rows = [(f"full/{k}", t, k, True) for k, t in full_texts().items()]
    rows += [(f"reflowed/{k}", "\n".join(textwrap.wrap(t, 50)), k, True) for k, t in full_texts().items()]
    rows += [(f"wrapped/{k}", f"{commented(t, 44, '#')}\n{filler}", k, False) for k, t in headers.items()]
    rows += [(f"inline/{k}", f"{filler} {t} {filler}", k, False) for k, t in headers.items()]
    rows += [
        ("mit", "The MIT License (MIT)\n\nCopyright (c) 2019 Some Body\n\n" + "\n".join(textwrap.wrap(headers["MIT"], 70)), "MIT", True),
        ("mit part", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files\n" + filler, "MIT", False),
        ("gpl lines", " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n" + filler, "GPL-3.0", False),
        ("spdx", "// SPDX-License-Identifier: GPL-2.0-or-later\n" + filler, "GPL-2.0", False),
        ("two lines", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n" + filler, "GPL-3.0", False),
        ("apache", "Apache License\n" + filler, "Apache-2.0", False),
        ("prose", "They spoke of the GNU project, of the Apache License and of permission to use software. " + filler, None, False),
        ("no", filler, None, False), ("null", None, None, False), ("empty", "", None, False),
    ]
    bsd = "/usr/share/common-licenses/BSD"
    if os.path.exists(bsd):
        rows.append(("bsd", open(bsd).read(), "BSD-3-Clause", True))
    got = {r.path: (r.licence, r.is_file) for r in own_licence(spark.createDataFrame([x[:2] for x in rows], "path string, text string"), wide=True).collect()}
    assert got == {p: (k, f) for p, _, k, f in rows}


def test_windows_against_plain_version(spark):
    from tessera.llm.licences import HEADERS, WORD, weights, windowed

    rng, keyed = random.Random(4), {f"{i}": t for i, (_, t) in enumerate(HEADERS)}
    idf, vectors = weights(keyed)
    texts = []
    for i in range(25):
        w = rng.choice(HEADERS)[1].lower().split()
        keep = [x for x in w if rng.random() < rng.choice([1, 0.9, 0.7])]
        texts.append(" ".join(["license", *(f"x{rng.randrange(50)}" for _ in range(rng.randrange(60))), *keep, *(rng.choice(w) for _ in range(rng.randrange(40)))]))
    want = {}
    for i, t in enumerate(texts):
        w = re.findall(WORD, t)
        for k, v in vectors.items():
            n = len(re.findall(WORD, keyed[k].lower()))
            for at in range(max(len(w) - n, 0) + 1):
                c = Counter(w[at : at + n])
                u = {x: m * idf.get(x, math.log(1 + len(vectors)) + 1) for x, m in c.items()}
                score = sum(u[x] * v.get(x, 0) for x in u) / math.sqrt(sum(x * x for x in u.values()))
                if score >= 0.75:
                    want.setdefault(i, []).append((at, HEADERS[int(k)][0], score))
    rows = windowed(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", 0.75).select("i", "_hits").collect()
    for r in rows:
        a, b = sorted((h.at, h.licence, h.score) for h in r._hits), sorted(want.get(r.i, []))
        assert [x[:2] for x in a] == [x[:2] for x in b] and all(abs(x[2] - y[2]) < 1e-5 for x, y in zip(a, b, strict=True))
    assert sum(map(len, want.values())) > 100
