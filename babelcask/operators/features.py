"""Tokens and word-bounded character n-gram counts.

Grams are taken inside words, each word padded with ``<`` and ``>``, so the
work is linear in the text length (a gram window sliding over a whole text is
quadratic in Spark's substring).  Every word of the whole text is used.

Plan shape: the input is hash-partitioned by ``doc_id`` once (the only
shuffle of the text); exploding and counting per (doc, gram) then runs
inside that partitioning, and so do all later per-document aggregations and
joins on ``doc_id`` of a scoring pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from babelcask.functions.text import WORD_SPLIT, padded, truncate, words
from babelcask.session import work_partitions

GRAM = 3


def token_stats(df: DataFrame, max_tokens: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: whole-text token count, tokens kept under the limit, tokens cut."""
    n = F.size(words(text_col))
    return df.select(
        id_col,
        n.cast("long").alias("n_tokens"),
        F.least(n, F.lit(max_tokens)).cast("long").alias("n_kept"),
        F.greatest(n - F.lit(max_tokens), F.lit(0)).cast("long").alias("n_cut"),
    )


def token_sequences(df: DataFrame, max_tokens: int, prefix=None, id_col: str = "doc_id", text_col: str = "text",
                    keep: tuple = ()) -> DataFrame:
    """(id, keep..., tokens, n_tokens, n_cut): the tokens a model of ``max_tokens`` inputs is given.

    ``prefix``: a text put before (language and separator); its tokens count
    against the limit, and the text's tokens are cut from the end.  A prefix
    that alone passes the limit is cut, too.  Nulls have no tokens.
    """
    none = F.array().cast("array<string>")
    body = F.coalesce(words(text_col), none)
    head = none if prefix is None else F.coalesce(words(prefix), none)
    whole = df.select(id_col, *keep, F.concat(head, body).alias("_all"))
    return whole.select(id_col, *keep, truncate("_all", max_tokens).alias("tokens"),
                        F.size("_all").cast("long").alias("n_tokens"),
                        F.greatest(F.size("_all") - F.lit(max_tokens), F.lit(0)).cast("long").alias("n_cut"))


def gram_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple = (),
                n: int = GRAM, partition: bool = True, n_parts: int | None = None) -> DataFrame:
    """(id, carry..., gram, n): count of each gram in each document.

    A document without any word keeps one row with a null gram and ``n = 0``,
    so that scoring still sees it.  ``carry`` columns (class, language, fold,
    split...) depend on the document only; carrying them avoids a join of the
    large count table with a document table later.

    Words and gram positions are two plain generators and the gram is a
    ``substring`` in a projection: all of it stays in generated code (nested
    lambda functions are interpreted and were 3x slower).
    """
    carry = list(carry)
    src = df.select(id_col, *carry, text_col)
    if partition:
        src = src.repartition(n_parts or work_partitions(df), id_col)
    w = src.select(id_col, *carry, F.explode_outer(F.split(F.lower(F.col(text_col)), WORD_SPLIT)).alias("_w"))
    # empty pieces from leading or trailing blanks are not words (they give a
    # null gram, counted 0), and a document keeps one row even with no word
    w = w.select(id_col, *carry,
                 F.when(F.col("_w") == F.lit(""), F.lit(None)).otherwise(padded("_w")).alias("_pw"))
    pos = w.select(id_col, *carry, "_pw",
                   F.explode_outer(F.sequence(F.lit(1), F.length("_pw") - (n - 1))).alias("_i"))
    grams = pos.select(id_col, *carry, F.substring(F.col("_pw"), F.col("_i"), n).alias("gram"))
    return grams.groupBy(id_col, *carry, "gram").agg(F.count("gram").alias("n"))
