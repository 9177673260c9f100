"""Packing against a plain tokenisation, and the rules of the places."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a", "Hello world's end", "two  blanks here ", "tab\tand \n lines \n\n x", "café à la <|endoftext|> crème", "word " * 3000, "x" * 5000, "Same text. " * 40, "Same text. " * 40]


def plain(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def test_coder_gives_the_ids_of_the_library():
    from tessera.llm.packing import Encoder

    own, rng = Encoder(PATH), np.random.default_rng(4)
    assert own.coder
    odd = list("ab zé\u00a0\u0085\u2028\t\n\r'\u0301١٢½日😀.,<|\x1c\x00") + ["'ll", "'s", "<|endoftext|>"]
    for _ in range(300):
        t = "".join(rng.choice(odd, rng.integers(1, 40)))
        assert np.frombuffer(own(t), "<u4").tolist() == plain(t)[:-1]


def frame(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, sequence_id string, offset int")


def test_pieces_and_places(spark):
    from tessera.llm.packing import pack, pieces

    rows = pack(pieces(frame(spark), PATH)).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append(r)
    for i, t in enumerate(TEXTS):
        ids, got = plain(t), sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(-(-len(ids) // 1024)))
        assert sum(r.length for r in got) == len(ids) and all(r.length == 1024 for r in got[1:])
        for r in got:
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for own in by_bin.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024


def test_sequences_hold_the_ids(spark):
    from tessera.llm.packing import pack, pieces

    docs = frame(spark)
    got = defaultdict(dict)
    for r in pack(pieces(docs, PATH, with_ids=True)).collect():
        assert len(r.ids) == r.length
        got[r.doc_id][r.piece] = r.ids
    assert all(sum((own[i] for i in sorted(own)), []) == plain(TEXTS[d]) for d, own in got.items()) and len(got) == len(TEXTS)


def test_null_and_repeated_ids(spark):
    from tessera.llm.packing import pack, pieces

    rows = [(None, "a b"), (None, None), (7, "same"), (7, "same"), (7, "other " * 2000)]
    got = pack(pieces(spark.createDataFrame(rows, "doc_id long, text string"), PATH)).collect()
    assert sorted((r.doc_id or -1, r.piece, r.length) for r in got) == sorted((d or -1, i, n) for d, t in rows for i, n in enumerate(cut(len(plain(t)))))
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)


def cut(n):
    return [n % 1024 or 1024] + [1024] * (-(-n // 1024) - 1)


def test_little_waste_with_many_more_pieces_than_open_bins(spark):
    from pyspark.sql import functions as F

    from tessera.llm.packing import pack

    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (F.pmod(F.xxhash64("id"), F.lit(1024)) + 1).alias("length"), F.crc32(F.col("id").cast("string")).alias("ids_crc32"))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = pack(rows).agg(F.sum("length"), F.countDistinct("sequence_id"), F.max(F.col("offset") + F.col("length")), F.count("*")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[3] == 60_000 and got[2] <= 1024 and got[1] <= 1.01 * got[0] / 1024


def test_empty_table(spark):
    from tessera.llm.packing import pack, pieces

    assert pack(pieces(frame(spark).limit(0), PATH)).count() == 0


def test_best_fit_against_a_list_of_bins():
    from tessera.llm.packing import BestFit

    rng = np.random.default_rng(1)
    own, bins, made = BestFit(100, 5), {}, 0
    for n in rng.integers(1, 101, 2000).tolist():
        b, at = own.place(n)
        fit = min((free for free in bins.values() if free >= n), default=None)
        if fit is None:
            assert b == made and at == 0
            made, free = made + 1, 100
        else:
            assert bins[b] == fit and at == 100 - fit
            free = bins.pop(b)
        if free > n:
            if len(bins) >= 5:
                least = min(bins.values())
                gone = [k for k in bins if bins[k] == least and k not in own.by_free[least]]
                bins.pop(gone[0])
            bins[b] = free - n


RUNS = ["a" + " " * 2_000_000 + "b", "\n" * 2_000_000 + "!", "x" * 2_000_000, "a" + " \n\u3000" * 9_000 + "<|endoftext|>" + "\x85" * 6000, " " * 5000, "a\x1f" * 6000 + " " * 4999 + "\x1fb " + "\t" * 7000 + "7"]


@pytest.mark.parametrize("text", RUNS, ids=range(len(RUNS)))
def test_long_runs(text):
    from tessera.llm.packing import Encoder

    assert np.frombuffer(Encoder(PATH)(text), "<u4").tolist() == plain(text)[:-1]


def test_waste_does_not_hang_on_shuffle_partitions(spark):
    from tessera.llm.packing import PIECES, pack

    rng = np.random.default_rng(5)
    rows = [(i, 0, 0, int(n), i) for i, n in enumerate(np.minimum(1024, rng.gamma(1.2, 260, 12_000).astype(int) + 1))]
    cut = spark.createDataFrame(rows, PIECES)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("8", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert pack(cut).select("sequence_id").distinct().count() < 1.005 * sum(r[3] for r in rows) / 1024 + 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
