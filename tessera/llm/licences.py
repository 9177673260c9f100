"""Licence scans: TF-IDF cosine to licence templates, then inheritance along directories.

Native DataFrame functions only.  Every line of a text is a header candidate; it is compared with each
template by the cosine of their sparse TF-IDF vectors, whose inverse document frequencies come from the
templates (a fixed list, of a size that does not grow with the corpus), so a line needs only the words it
shares with them.  A text whose header makes up most of its words is a licence file of its directory.  A
text without a licence of its own takes that of the nearest ancestor directory with a licence file, found by
joining the directories of its path with those of the licence files.

With ``wide``, as in the registered query, a text is also compared as a whole with the full licence texts
(folder licence_texts), and every run of words as long as a usual header or short licence with that header,
whatever lines it is wrapped to or stands in.  Sums over all windows come from running sums; only windows
that may reach the threshold by these are compared in full.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import blocks

#: Notices by licence id.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_GPL = (
    "{0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public License as published by the Free Software Foundation; either version {3} of the License, "
    "or (at your option) any later version."
)
_NO_WARRANTY = " {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
    "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
    "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above "
    "copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
    "the documentation and/or other materials provided with the distribution."
)
#: Fixed values: (licence, text) of usual headers and of licences that are no longer than one.
HEADERS = [
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", _APACHE + " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", _MIT),
    ("MIT", _MIT + " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", _BSD + " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY"),
    ("BSD-3-Clause", _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    *((k, _GPL.format("This program", colon, "", v) + rest) for k, v, colon in (("GPL-2.0", "2", ";"), ("GPL-3.0", "3", ":")) for rest in ("", _NO_WARRANTY.format("This program", ""))),
    *((k, _GPL.format("This library", ";", "Lesser ", v) + rest) for k, v in (("LGPL-2.1", "2.1"), ("LGPL-3.0", "3")) for rest in ("", _NO_WARRANTY.format("This library", "Lesser "))),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]
#: Titles and tags, which count as lines of their own only, since prose has their words too.
TITLES = [
    ("MIT", "The MIT License (MIT)"), ("MIT", "MIT License"), ("Apache-2.0", "Apache License"), ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"), ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"), ("MPL-2.0", "Mozilla Public License Version 2.0"), ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-2-Clause", "BSD 2-Clause License"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"), ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    *((k, f"SPDX-License-Identifier: {k}{end}") for k in ("Apache-2.0", "MIT", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "MPL-2.0", "BSD-3-Clause", "BSD-2-Clause", "CC-BY-4.0", "CC-BY-NC-4.0") for end in ("", "-or-later", "-only") if not end or "GPL" in k),
]
#: Parts of words of which every header, title and full text has one.
SIGNS = ["licen", "permission", "redistribut"]
#: What stands for a licence's name in its full text; a text without any of them is not compared as a whole.
NAMES = ["apache", "gnu", "mozilla", "creative commons"]
#: Words of everyday text (German "mit" too), the commonest first.
COMMON = [
    "the", "of", "and", "to", "in", "is", "for", "this", "a", "with", "by", "or", "mit", "are", "use", "under", "work", "form", "without", "3", "v", "nc", "source", "terms",
    "subject", "2.0", "4.0", "version", "code", "general", "forms", "public",
]
WORD = "[a-z0-9.]*[a-z0-9]"


def _words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def weights(templates: dict[str, str]) -> tuple[dict[str, float], dict[str, dict[str, float]]]:
    """idf of the templates' words, and each template's TF-IDF vector of length 1."""
    df, n = Counter(w for t in templates.values() for w in set(_words(t))), len(templates)
    idf = {w: math.log((1 + n) / (1 + c)) + 1 for w, c in df.items()}
    out = {}
    for k, t in templates.items():
        v = {w: c * idf[w] for w, c in Counter(_words(t)).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        out[k] = {w: x / size for w, x in v.items()}
    return idf, out


def needed(vectors: dict[str, dict[str, float]], least: float) -> set[str]:
    """Words of which a line must have one to reach the cosine ``least`` with any template.

    Those left out of a template have together a length under ``least``, so they alone cannot reach it.
    Common words are left out first, then those of little weight.
    """
    out: set[str] = set()
    for v in vectors.values():
        left = 0.0
        for w in sorted(v, key=lambda w: (COMMON.index(w) if w in COMMON else len(COMMON), v[w], w)):
            if left + v[w] ** 2 < least**2:
                left += v[w] ** 2
            else:
                out.add(w)
    return out


def full_texts() -> dict[str, str]:
    return {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}


def damped(texts: dict[str, str]) -> tuple[dict[str, float], dict[str, dict[str, float]]]:
    """Like weights(), with a count c as 1 + ln c: in long texts the commonest words would else decide."""
    idf = weights(texts)[0]
    out = {}
    for k, t in texts.items():
        v = {w: (1 + math.log(c)) * idf[w] for w, c in Counter(_words(t)).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        out[k] = {w: x / size for w, x in v.items()}
    return idf, out


def _adds(table: Column):
    return lambda a, x: a + F.coalesce(table[x], F.lit(0.0))


def _table(values: dict[str, float]) -> Column:
    """As one constant: an expression for each entry would fill the driver's plans."""
    return F.from_json(F.lit(json.dumps(dict(sorted(values.items())))), "map<string,double>")


def _numbered(parts: list[tuple[str, str]]) -> dict[str, str]:
    """By licence and number, as a licence has several."""
    return {f"{k}#{i:02d}": t for i, (k, t) in enumerate(parts)}


HIT = "struct<score:double,at:int,n:int,licence:string>"
UNIT = 1_000_000  # weights are added up as whole numbers, so that running sums have no error


def windowed(files: DataFrame, low: str, least: float) -> DataFrame:
    """Add _w (words of the text in column ``low``) and _hits: the windows of HEADERS' lengths whose cosine is at least ``least``.

    A window's squared length is at least the sum of its words' squared weights, and that sum and its product with
    a header are differences of running sums.  A text without enough of a header's words has no window of it; one
    without any of SIGNS is not looked at.
    """
    headers = _numbered(HEADERS)
    idf, vectors = weights(headers)
    rare, idf_t = math.log(1 + len(vectors)) + 1, _table(idf)
    weight = lambda x: F.coalesce(idf_t[x], F.lit(rare))
    zero = F.lit(0.0)
    some = reduce(lambda a, b: a | b, [F.contains(F.col(low), F.lit(w)) for w in SIGNS])
    out = files.withColumn("_w", F.when(some, F.regexp_extract_all(F.col(low), F.lit(WORD), F.lit(0))).otherwise(F.array().cast("array<string>")))
    own = F.array_distinct("_w")
    out = out.withColumn("_own", F.when(F.size("_w") > 0, F.filter(own, lambda x: idf_t[x].isNotNull())).otherwise(F.array().cast("array<string>")))
    table = F.array(*(F.struct(F.lit(k.split("#")[0]).alias("licence"), F.lit(len(_words(headers[k]))).alias("n"), _table(v).alias("m")) for k, v in vectors.items()))
    mass = lambda h: F.aggregate("_own", zero, lambda a, x: a + F.coalesce(h["m"][x] * h["m"][x], zero))
    out = out.withColumn("_h", F.when(F.size("_own") > 2, F.filter(table, lambda h: mass(h) >= least**2 - 1e-9)).otherwise(F.slice(table, 1, 0)))
    whole = lambda x: F.round(x * UNIT).cast("bigint")
    squares = running(F.transform("_w", lambda x: whole(weight(x) * weight(x))))
    out = out.withColumn("_q", F.when(F.size("_h") > 0, squares).otherwise(F.array().cast("array<bigint>")))

    def exact(h: Column, at: Column) -> Column:
        w = F.slice("_w", at + 1, h["n"])
        ends = lambda a: a["s"] + a["n"] * weight(a["w"]) * a["n"] * weight(a["w"])
        run = F.struct(F.lit("").alias("w"), zero.alias("n"), zero.alias("s"))
        step = lambda a, x: F.when(x == a["w"], F.struct(a["w"].alias("w"), (a["n"] + 1).alias("n"), a["s"].alias("s"))).otherwise(F.struct(x.alias("w"), F.lit(1.0).alias("n"), ends(a).alias("s")))
        dot = F.aggregate(w, zero, lambda a, x: a + weight(x) * F.coalesce(h["m"][x], zero))
        score = F.round(dot / F.sqrt(F.aggregate(F.array_sort(w), run, step, ends)), 6)
        return F.struct(score.alias("score"), at.cast("int").alias("at"), F.size(w).alias("n"), h["licence"].alias("licence"))

    def of_header(h: Column) -> Column:
        sums = running(F.transform("_w", lambda x: whole(weight(x) * F.coalesce(h["m"][x], zero))))
        total = lambda a, at, to: F.when(to > 0, F.get(a, to - 1)).otherwise(0) - F.when(at > 0, F.get(a, at - 1)).otherwise(0)

        def starts(d: Column) -> Column:
            def may(at: Column) -> Column:
                to = F.least(at + h["n"], F.size("_w"))
                x, y = total(d, at, to) / UNIT + 1e-4, total(F.col("_q"), at, to) / UNIT - 1e-3
                return x * x >= least * least * y

            return F.filter(F.sequence(F.lit(0), F.greatest(F.size("_w") - h["n"], F.lit(0))), may)

        # the array of one lets the sums be made once and not for each window
        at = F.flatten(F.transform(F.array(sums), starts))
        return F.filter(F.transform(at, lambda a: exact(h, a)), lambda x: x["score"] >= least)

    hits = F.flatten(F.transform("_h", of_header)).cast(f"array<{HIT}>")
    none = F.array().cast(f"array<{HIT}>")
    return out.withColumn("_hits", F.when(F.size("_h") > 0, hits).otherwise(none)).drop("_own", "_h", "_q")


def running(values: Column, width: int = 128) -> Column:
    """Running sums of an array of longs, by blocks: an array is copied for each element that is put to it."""
    fold = lambda a, first: F.aggregate(
        a, F.struct(first.alias("s"), F.array().cast("array<bigint>").alias("all")),
        lambda acc, x: F.struct((acc.s + x).alias("s"), F.concat(acc["all"], F.array(acc.s + x)).alias("all")), lambda acc: acc["all"],
    )
    zero = F.lit(0).cast("bigint")

    def blocked(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(width)), lambda a: F.slice(v, a, width))
        sums = F.transform(F.array(fold(F.transform(parts, lambda p: F.aggregate(p, zero, lambda a, x: a + x)), zero)), lambda s: F.concat(F.array(zero), s))
        return F.flatten(F.transform(F.arrays_zip(parts.alias("p"), sums[0].alias("s")), lambda z: F.when(z["p"].isNotNull(), fold(z["p"], z["s"])).otherwise(F.array().cast("array<bigint>"))))

    return F.flatten(F.transform(F.array(values), blocked))


def as_whole(files: DataFrame, low: str, least: float) -> DataFrame:
    """Add _full (score, licence): the full licence text that is most like the whole text, null under ``least``."""
    idf, vectors = damped(full_texts())
    rare, zero = math.log(1 + len(vectors)) + 1, F.lit(0.0)
    names, idf_t = sorted(vectors), _table(idf)
    tables = [_table({w: idf[w] * x for w, x in vectors[k].items()}) for k in names]
    some = F.contains(F.col(low), F.lit("licen")) & (F.size("_w") > 200) & reduce(lambda a, b: a | b, [F.contains(F.col(low), F.lit(x)) for x in NAMES])
    counted = F.struct(F.lit("").alias("w"), F.lit(0).alias("n"), F.array().cast("array<struct<w:string,n:int>>").alias("all"))
    put = lambda a: F.when(a["n"] > 0, F.concat(a["all"], F.array(F.struct(a["w"].alias("w"), a["n"].alias("n"))))).otherwise(a["all"])
    step = lambda a, x: F.when(x == a["w"], F.struct(a["w"].alias("w"), (a["n"] + 1).alias("n"), a["all"].alias("all"))).otherwise(F.struct(x.alias("w"), F.lit(1).alias("n"), put(a).alias("all")))
    counts = F.aggregate(F.array_sort("_w"), counted, step, put)
    out = files.withColumn("_c", F.when(some, counts).otherwise(F.array().cast("array<struct<w:string,n:int>>")))
    tf = lambda x: 1 + F.log(x["n"].cast("double"))
    size = F.sqrt(F.aggregate("_c", zero, lambda a, x: a + F.pow(tf(x) * F.coalesce(idf_t[x["w"]], F.lit(rare)), F.lit(2.0))))
    adds = lambda t: lambda a, x: a + tf(x) * F.coalesce(t[x["w"]], zero)
    per = [F.struct(F.round(F.aggregate("_c", zero, adds(t)) / F.col("_size"), 6).alias("score"), F.lit(k).alias("licence")) for k, t in zip(names, tables, strict=True)]
    best = reduce(lambda a, b: F.when(b["score"] > a["score"], b).otherwise(a), per)
    out = out.withColumn("_size", F.when(F.size("_c") > 0, size)).withColumn("_full", F.when(F.col("_size").isNotNull(), best))
    return out.withColumn("_full", F.when(F.col("_full.score") >= least, F.col("_full"))).drop("_c", "_size")


def titled(files: DataFrame, low: str) -> DataFrame:
    """Add _titles (licence, n words): lines, and pairs of lines that follow each other, that have a title's words and no others."""
    table = F.create_map(*(x for t, k in sorted({" ".join(_words(t)): k for k, t in TITLES}.items()) for x in (F.lit(t), F.lit(k))))
    said = F.filter(F.transform(F.split(low, "\n"), lambda x: F.when(F.length(x) <= 200, F.array_join(F.regexp_extract_all(x, F.lit(WORD), F.lit(0)), " ")).otherwise("-")), lambda x: x != "")
    out = files.withColumn("_t", F.when(F.size("_w") > 0, said).otherwise(F.array().cast("array<string>")))
    pairs = F.zip_with("_t", F.slice("_t", 2, F.greatest(F.size("_t"), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), F.coalesce(b, F.lit("-"))))
    hit = lambda a: F.transform(F.filter(a, lambda x: table[x].isNotNull()), lambda x: F.struct(table[x].alias("licence"), F.size(F.split(x, " ")).alias("n")))
    return out.withColumn("_titles", F.concat(hit(F.col("_t")), hit(pairs))).drop("_t")


def path_of(docs: DataFrame) -> Column:
    """Path of a corpus document: /source/lang/hundred/doc_id.txt, from its columns (nulls: '_')."""
    part = lambda c: F.coalesce(F.nullif(F.regexp_replace(F.col(c).cast("string"), "/", "_"), F.lit("")), F.lit("_"))
    hundred = F.coalesce(F.floor(F.col("doc_id") / 100).cast("string"), F.lit("_"))
    return F.concat(F.lit("/"), part("source"), F.lit("/"), part("lang"), F.lit("/"), hundred, F.lit("/"), part("doc_id"), F.lit(".txt"))


def own_licence(files: DataFrame, templates: dict[str, str] | None = None, least: float = 0.75, whole: float = 0.5, wide: bool = False) -> DataFrame:
    """files (path, text, ...) with licence, score (of the best line) and is_file.

    licence is null if no line reaches ``least``; lines that cannot are not scored.  Ties go to the first line and then to the
    first template by name.  Null and empty texts have score 0.  is_file: words of lines that reach ``least`` are at
    least the share ``whole`` of all words.

    wide: a full licence text decides first and makes a licence file; then the best of titles (score 1), lines and windows
    of HEADERS' lengths, in this order where equal, the first of each.
    """
    idf, vectors = weights(templates or TEMPLATES)
    rare, idf_t = math.log(1 + len(vectors)) + 1, _table(idf)
    tables = {k: _table({w: idf[w] * x for w, x in v.items()}) for k, v in sorted(vectors.items())}
    must = sorted(needed(vectors, least))

    def any_of(low: Column) -> Column:
        """Whether the text may hold such a word: long ones anywhere, short ones on their own."""
        alone = lambda w: F.rlike(low, F.lit(f"{re.escape(w)}(?<![a-z0-9.]{re.escape(w)})(?![a-z0-9])"))
        tests = [F.contains(low, F.lit(w)) & (F.lit(True) if len(w) > 3 else alone(w)) for w in sorted(must, key=len, reverse=True)]
        return reduce(lambda a, b: a | b, tests)

    def scored(line: Column) -> Column:
        w = F.regexp_extract_all(line, F.lit(WORD), F.lit(0))
        zero = F.lit(0.0)
        weight = lambda x: F.coalesce(idf_t[x], F.lit(rare))
        ends = lambda a: a["s"] + F.when(a["n"] > 0, (a["n"] * weight(a["w"])) * (a["n"] * weight(a["w"]))).otherwise(zero)
        run = F.struct(F.lit("").alias("w"), zero.alias("n"), zero.alias("s"))
        step = lambda a, x: F.when(x == a["w"], F.struct(a["w"].alias("w"), (a["n"] + 1).alias("n"), a["s"].alias("s"))).otherwise(F.struct(x.alias("w"), F.lit(1.0).alias("n"), ends(a).alias("s")))
        dots = [F.aggregate(w, zero, _adds(t)).alias(f"d{i}") for i, t in enumerate(tables.values())]
        return F.struct(F.size(w).alias("n"), F.sqrt(F.aggregate(F.array_sort(w), run, step, ends)).alias("size"), *dots)

    def best(s: Column) -> Column:
        per = [F.struct((s[f"d{i}"] / s["size"]).alias("score"), F.lit(k).alias("licence")) for i, k in enumerate(tables)]
        top = reduce(lambda a, b: F.when(b["score"] > a["score"], b).otherwise(a), per)
        return F.struct(F.coalesce(F.round(top["score"], 6), F.lit(0.0)).alias("score"), top["licence"].alias("licence"), s["n"].alias("n"))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    few = F.filter(F.split("_low", "\n"), any_of)
    some = F.when(F.col("_may"), few).otherwise(F.array().cast("array<string>"))
    out = files.withColumn("_low", F.lower(text)).withColumn("_may", any_of(F.col("_low"))).withColumn("_l", some).withColumn("_l", F.transform("_l", scored)).withColumn("_l", F.filter("_l", lambda s: s["n"] > 0))
    out = out.withColumn("_l", F.transform("_l", best))
    top = F.aggregate("_l", F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("licence"), F.lit(0).alias("n")), lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))
    out = out.withColumn("_b", top)
    marked = F.aggregate("_l", F.lit(0), lambda a, x: a + F.when(x["score"] >= least, x["n"]).otherwise(0))
    out = out.withColumn("score", F.col("_b.score")).withColumn("licence", F.when(F.col("_b.score") >= least, F.col("_b.licence")))
    if wide:
        out = as_whole(titled(windowed(out, "_low", least), "_low"), "_low", least)
        hit = F.aggregate("_hits", F.lit(None).cast(HIT), lambda a, x: F.when(a.isNull() | (x["score"] > a["score"]) | ((x["score"] == a["score"]) & (x["at"] < a["at"])), x).otherwise(a))
        out = out.withColumn("_hit", hit)
        more = F.coalesce(F.col("_hit.score"), F.lit(0.0))
        title = F.get("_titles", F.lit(0))["licence"]
        full = F.col("_full").isNotNull()
        own = F.when(full, F.col("_full.licence")).when(title.isNotNull(), title).when(more > F.col("score"), F.col("_hit.licence")).otherwise(F.col("licence"))
        best_score = F.when(full, F.col("_full.score")).when(title.isNotNull(), 1.0).otherwise(F.greatest("score", more))
        out = out.withColumns({"licence": own, "score": best_score})
        covered = F.size(F.array_distinct(F.flatten(F.transform("_hits", lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1)))))
        marked = F.greatest(marked + F.aggregate("_titles", F.lit(0), lambda a, x: a + x["n"]), covered)
    all_words = F.when(F.col("licence").isNotNull(), F.size(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "))).otherwise(0)
    is_file = F.col("licence").isNotNull() & (marked >= whole * all_words)
    if wide:
        is_file = is_file | full
    return out.withColumn("is_file", is_file).drop("_l", "_b", "_low", "_may", "_w", "_hits", "_hit", "_titles", "_full")


def inherited(scanned: DataFrame) -> DataFrame:
    """scanned (path, licence, is_file, ...) with effective (own or inherited licence) and from_dir (null: own or none).

    A directory's licence is that of its first licence file by path.  Joins are on directories, of which there are
    far fewer than files; the documents' side moves only paths and is split where a directory is hot.
    """
    parent = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_s"), F.lit(1))), lambda i: F.array_join(F.slice("_s", F.lit(1), i), "/"))
    files = scanned.filter("is_file").groupBy(parent(F.col("path")).alias("dir")).agg(F.min_by("licence", "path").alias("dir_licence"))
    dirs = scanned.select(parent(F.col("path")).alias("own")).distinct().withColumn("_s", F.split("own", "/"))
    steps = dirs.select("own", F.posexplode(up).alias("depth", "dir")).join(files, "dir")
    near = steps.groupBy("own").agg(F.max_by(F.struct("dir", "dir_licence"), "depth").alias("_n"))
    out = scanned.withColumn("own", parent(F.col("path"))).join(near, "own", "left")
    take = F.col("licence").isNull() & F.col("_n").isNotNull()
    return out.withColumn("effective", F.coalesce("licence", "_n.dir_licence")).withColumn("from_dir", F.when(take, F.col("_n.dir"))).drop("own", "_n")


def scan(docs: DataFrame, wide: bool = False) -> DataFrame:
    """Per document: doc_id, path, licence, score, is_file, effective, from_dir; wide as in own_licence."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), path_of(docs).alias("path"), "text")
    scanned = blocks.written(own_licence(rows, wide=wide).drop("text"), f"{blocks.shared_dir(docs.sparkSession, 'licences')}/own")
    return inherited(scanned).select("doc_id", "path", "licence", "score", "is_file", "effective", "from_dir")
