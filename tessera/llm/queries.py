"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.neighbours import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.ngrams import scored_corpus

    out = scored_corpus(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import toxicity, train

    docs = _table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, _table(spark, sf_dir, "labels")))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pii import find_pii, summary

    return summary(find_pii(_table(spark, sf_dir, "documents")))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.repeats import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.similarity import similar_groups

    return similar_groups(_table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.chat import digests, examples

    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    return digests(examples(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.licences import scan

    return scan(_table(spark, sf_dir, "documents"), wide=True)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.contamination import decontaminate

    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack, pieces

    return pack(pieces(_table(spark, sf_dir, "documents"), tokenizer_path()))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.spelling import variants

    return variants(_table(spark, sf_dir, "documents"))


def op13_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import blocks
    from tessera.llm.archives import read_archives, write_archives

    folder = blocks.shared_dir(spark, "archives")
    write_archives(_table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return importlib.import_module("tessera.llm.oracles").ORACLES
