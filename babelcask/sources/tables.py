"""Parquet sources and the labelled-corpus stand-in.

``corpus(doc_id, text, label, language)`` is ``documents JOIN labels``:
``label`` is ``negative`` when toxic, else ``positive`` when of quality, else
``neutral``; ``language`` is ``lang``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from babelcask.functions.text import null_if_na
from babelcask.session import input_bytes


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sentiment_of(toxic, quality):
    return (F.when(toxic == 1, F.lit("negative"))
             .when(quality == 1, F.lit("positive"))
             .otherwise(F.lit("neutral")))


def raw_corpus(spark: SparkSession, sf_dir: str, n_parts: int | None = None, broadcast_bytes: int | None = None) -> DataFrame:
    """Labelled rows before null handling: (doc_id, text, label, language).

    With ``n_parts`` the rows come hash-partitioned by ``doc_id`` into that
    many parts, the text moved once: labels of at most ``broadcast_bytes`` (by
    the optimiser's statistics; default Spark's own limit) go to every task, so
    only labelled texts move; larger ones are partitioned like the documents
    before the join, which then adds no exchange, nor does any later step by
    document.  Without, the plan is Spark's own (no text moves for columns
    that do not need it).
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("language"))
    labels = read_table(spark, sf_dir, "labels").select(
        "doc_id", sentiment_of(F.col("toxic"), F.col("quality")).alias("label"))
    if broadcast_bytes is None:
        broadcast_bytes = int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    if n_parts is None:
        joined = docs.join(labels, "doc_id")
    elif input_bytes(labels) <= broadcast_bytes:
        joined = docs.join(F.broadcast(labels), "doc_id").repartition(n_parts, "doc_id")
    else:
        joined = docs.repartition(n_parts, "doc_id").join(labels.repartition(n_parts, "doc_id").hint("merge"), "doc_id")
    return joined.select("doc_id", "text", "label", "language")


def clean_corpus(df: DataFrame, columns=("text", "label", "language")) -> DataFrame:
    """Null tokens become nulls; rows with any null among ``columns`` go."""
    cols = list(columns)
    out = df
    for c in cols:
        out = out.withColumn(c, null_if_na(F.col(c)))
    return out.dropna(how="any", subset=cols)


def corpus(spark: SparkSession, sf_dir: str, n_parts: int | None = None, broadcast_bytes: int | None = None) -> DataFrame:
    return clean_corpus(raw_corpus(spark, sf_dir, n_parts, broadcast_bytes))


def unlabelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with no label row: the texts to predict (left anti join)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id")
    return docs.join(labels, "doc_id", "left_anti")
