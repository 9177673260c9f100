"""Each stage of the pipeline against a plain version."""

import random
from collections import defaultdict

import corpus_pipeline as p
from tests.llm.test_contamination import brute as contaminated
from tests.llm.test_packing import plain
from tests.llm.test_pii import base
from tests.llm.test_similarity import brute as groups


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    text = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    item, docs, labels = text(25), [], []
    for i in range(500):
        t, bad = text(rng.choice([3, 20, 90])), i % 6 == 0
        t += " scum moron" if bad else " ok then"
        if i % 25 == 1:
            t += " " + item
        if i % 10 == 3:
            t += f" mail me.{i}@mail.com or 10.1.2.{i % 200} é"
        docs.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, 1, int(bad)))
    docs += [(1000 + i, docs[i][1] + (" tail" if i % 2 else ""), "en", "s9", 1) for i in range(1, 60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    df, sf = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    columns, now, last = df.columns, {d[0]: d[1] for d in docs}, []
    for name, stage in p.STAGES:
        df = stage(spark, df, sf)
        df.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        rows = df.collect()
        if name == "toxicity":
            want = {d: t for d, t in now.items() if "scum" not in t}
        elif name == "similarity":
            want = {d: now[d] for d, _, c in groups(list(now.items())) if d == c}
        elif name == "contamination":
            want = {r[0]: now[r[0]] for r in contaminated(list(now.items()), [(1, item)]) if not r[-1]}
        elif name == "pii":
            want = {}
            for d, t in now.items():
                for k, a, b in sorted(base(t), key=lambda s: -s[1]):
                    t = f"{t[:a]}[{k.upper()}]{t[b:]}"
                want[d] = t
            assert all(r.n_chars == len(r.text) for r in rows if "[" in r.text)
        else:
            last, want = rows, now
        if name != "packing":
            assert df.columns == columns and {r.doc_id: r.text for r in rows} == want and len(rows) == len(want) < len(now) + (name == "pii")
        now = want
    size = defaultdict(int)
    for r in last:
        size[r.doc_id] += r.length
    assert size == {d: len(plain(t)) for d, t in now.items()}
    assert sorted(map(tuple, p.run(spark, sf).select("doc_id", "piece", "ids_crc32").collect())) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in last)


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    """Null and repeated ids, null, empty and long texts, and columns named like helpers go through every stage."""
    from pyspark.sql import functions as F

    rng = random.Random(3)
    text = lambda n: " ".join(f"v{rng.randrange(900)}" for _ in range(n))
    rows = [(i, text(12), "en", "s", 1) for i in range(40)] + [(None, text(9), None, None, None), (None, None, "en", "s", 0), (50, "", "en", "s", 0), (51, None, "en", "s", 0), (7, text(20), "en", "s", 2), (60, "long " * 30000, "en", "s", 3)]
    names = ["score", "n_words", "items", "contaminated", "base", "extra", "_base", "_spans", "_t", "_text", "file", "token", "rep", "component"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(f"own {c}") for c in names})
    spark.createDataFrame([(1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    key = lambda r: (str(r.doc_id), str(r.text))
    want, df, none = sorted(docs.collect(), key=key), docs, docs.limit(0)
    for name, stage in p.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        df.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        assert df.columns == docs.columns and sorted(df.collect(), key=key) == want, name
        none = stage(spark, none, str(tmp_path))
        assert none.columns == docs.columns and none.count() == 0
    packed = p.STAGES[-1][1](spark, df, str(tmp_path))
    assert packed.filter("piece = 0").count() == len(rows) and p.STAGES[-1][1](spark, none, str(tmp_path)).count() == 0
