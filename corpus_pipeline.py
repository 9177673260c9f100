"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs.  All but the last return the columns of documents, and further columns of the caller's.

Rows are judged one by one, whatever their ids: a null text is an empty one to every stage and stays null;
rows that repeat a doc_id stay or go each by its text, but near copies by their common id; rows without a doc_id
are kept by the similarity stage.  Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import blocks
from tessera.llm.contamination import RESULT, with_hits
from tessera.llm.packing import pack, pieces
from tessera.llm.pii import redacted
from tessera.llm.queries import tokenizer_path
from tessera.llm.similarity import first_of_groups
from tessera.llm.toxicity import train, with_scores

THRESHOLD = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model (3), fitted on the labelled ones, scores under the threshold.

    A model without terms (no labels of both classes, or no term that tells them apart) knows nothing against any
    document: all stay.
    """
    machine, score = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), blocks.unused(docs.columns, "score")
    if not len(machine.terms):
        return docs
    return with_scores(docs, machine, score).filter(F.col(score) < THRESHOLD).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each group of the n-gram Jaccard join (6)."""
    return first_of_groups(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word in an occurrence of a benchmark window (9)."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    kept = {c: blocks.unused([*docs.columns, *RESULT], f"_{c}") for c in docs.columns if c not in ("doc_id", "text")}
    hits = with_hits(docs.select("doc_id", "text", *(F.col(c).alias(n) for c, n in kept.items())), benchmark)
    return hits.filter(~F.col("contaminated")).select(*(F.col(kept.get(c, c)).alias(c) for c in docs.columns))


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data (4) replaced by its kind in brackets; n_chars follows."""
    return redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids and their places in sequences (10)."""
    return pack(pieces(docs, tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("similarity", drop_near_copies),
    ("contamination", drop_contaminated),
    ("pii", mask_private),
    ("packing", pack_sequences),
]

#: A fitted machine and a tokenizer are not SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), blocks.shared_dir(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = blocks.written(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
