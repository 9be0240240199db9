"""Corpus pipeline: quality rules, near-dedup, benchmark decontamination, personal data, pieces.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir)
and returns the documents it keeps, with the columns of ``documents`` (the
last one: the pieces).  ``run`` writes every stage's result as Parquet in the
shared folder and reads it back as the next one's input.

Rows with equal ids are one document: a stage that drops a document drops all
its rows.  A row with a null id is judged where a stage can judge a text
alone, and kept by the stages that compare documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from babelcask.llm import decontaminate, near_dup, perplexity, pii_vote, piece_lattice
from babelcask.llm.work import Staging, table


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the ids of ``gone(doc_id)``."""
    return docs.join(gone.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and their language's perplexity band keep."""
    return _without(docs, perplexity.score(docs).filter("NOT kept"))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the least id."""
    return _without(docs, near_dup.near_duplicates(docs).filter("NOT kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return _without(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by its kind; ``n_chars`` follows the text."""
    return (pii_vote.redact(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
            .select(docs.columns))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with what decoding them gives: (doc_id, n_pieces, ids_hash, text_sha256, round_trip)."""
    return piece_lattice.round_trip(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_dedup", minhash_dedup),
    ("decontamination", drop_contaminated),
    ("pii", redact_pii),
    ("pieces", piece_ids),
]

#: The stages' models have no SQL form; tests hold the pipeline against plain Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Staging(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage.write(step(spark, docs, sf_dir), name)
    return docs
