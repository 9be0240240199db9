"""Stratified train/test split and stratified k folds, exact and repeatable.

Rows are ordered inside their class by ``md5(seed || ':' || id)`` then id,
which stands in for a seeded random permutation and gives the same answer in
every run, partitioning and engine.

Split sizes follow the library rule: ``n_test = ceil(test_size * n)``,
``n_train = n - n_test``; per class the train quota is the floor of its
proportional share of ``n_train``, topped up by one for the classes with the
largest remainders (ties by class name).  Integer arithmetic throughout.

Fold ``f`` of a row is ``(offset(class) + rank_in_class - 1) % k``, where
``offset`` counts rows of classes sorting earlier: rows are dealt round-robin
over the class-sorted list, so per-class fold sizes differ by at most one.

Ranks are computed per (class, md5 bucket); each class gets as many bucket
bits as its size needs for about ``bucket_rows`` rows per bucket, so a class
holding a third of all rows is spread over many tasks, and the offsets table
has at most 2 N / bucket_rows + classes rows.  The class plan and the offsets
are broadcast only after counting them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from babelcask.operators.ranking import bucketed_rank, md5_bucket
from babelcask.session import cut_lineage

SEED = "42"
TEST_SIZE = 0.2
N_FOLDS = 5
# Rows per (class, bucket) window task the bucket resolution aims at.
BUCKET_ROWS = 1 << 20
# Largest class plan or offsets table (rows) that is broadcast.
MAX_BROADCAST_ROWS = 1 << 21


def order_key(id_col: str = "doc_id", seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(seed), F.lit(":"), F.col(id_col).cast("string")))


def ranked_in_class(df: DataFrame, class_col: str, id_col: str = "doc_id", seed: str = SEED,
                    bits=16, broadcast_offsets: bool = True) -> DataFrame:
    """Adds ``_h`` (order key) and ``rank_in_class`` (1-based, exact).

    ``bits``: md5 bucket bits, a number or a column constant inside each class.
    """
    d = df.withColumn("_h", order_key(id_col, seed))
    return bucketed_rank(d, [class_col], [F.col("_h"), F.col(id_col)], md5_bucket("_h", bits),
                         out="rank_in_class", broadcast_offsets=broadcast_offsets)


def bucket_bits(n, bucket_rows: int = BUCKET_ROWS) -> Column:
    """Bits of md5 prefix for a class of ``n`` rows: ceil(log2(n / bucket_rows)), within 0..32."""
    want = F.ceil(F.log2(F.col(n).cast("double") / F.lit(float(bucket_rows))))
    return F.least(F.lit(32), F.greatest(F.lit(0), want)).cast("int")


def class_plan(df: DataFrame, class_col: str, test_size: float = TEST_SIZE) -> DataFrame:
    """One row per class: n, train quota, and offset (rows of earlier classes).

    Computed on the K-row count table, so its windows have K rows.
    """
    counts = df.groupBy(class_col).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    earlier = Window.orderBy(class_col).rowsBetween(Window.unboundedPreceding, -1)
    c = (counts
         .withColumn("n_all", F.sum("n").over(everything))
         .withColumn("n_train", F.col("n_all") - F.ceil(F.lit(float(test_size)) * F.col("n_all")).cast("long"))
         # a product of two row counts passes 64 bits from about 3e9 rows on
         .withColumn("_share", F.col("n").cast("decimal(19,0)") * F.col("n_train").cast("decimal(18,0)"))
         .withColumn("_floor", F.expr("CAST(_share div n_all AS BIGINT)"))
         .withColumn("_rem", F.expr("CAST(_share % n_all AS BIGINT)"))
         .withColumn("_offset", F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("long")))
    c = c.withColumn("_need", F.col("n_train") - F.sum("_floor").over(everything))
    c = c.withColumn("_order", F.row_number().over(Window.orderBy(F.desc("_rem"), F.col(class_col))))
    return c.select(class_col, "n",
                    (F.col("_floor") + F.when(F.col("_order") <= F.col("_need"), 1).otherwise(0))
                    .cast("long").alias("n_train_quota"),
                    "_offset")


class ClassTooSmall(ValueError):
    """A stratified split or fold that the class sizes do not allow."""


def check_split(sizes, test_size: float) -> None:
    """The library's conditions on a stratified split: two rows a class, and a row of both parts for each class.

    ``sizes``: one row with ``k`` (classes), ``n`` (rows), ``least`` (rows of the smallest class).
    """
    n_test = math.ceil(test_size * sizes["n"])
    if sizes["least"] < 2:
        raise ClassTooSmall("the smallest class has one row only; a stratified split needs two rows of every class")
    for part, rows in (("test", n_test), ("train", sizes["n"] - n_test)):
        if rows < sizes["k"]:
            raise ClassTooSmall(f"the {part} part has {rows} rows, fewer than the {sizes['k']} classes")


def check_folds(sizes, n_folds: int) -> None:
    """The library's condition on stratified folds: some class has a row for every fold (``most``: its rows)."""
    if sizes["most"] < n_folds:
        raise ClassTooSmall(f"no class has as many rows as there are folds ({n_folds})")


def assign_split_and_fold(df: DataFrame, class_col: str = "label", id_col: str = "doc_id",
                          test_size: float = TEST_SIZE, n_folds: int = N_FOLDS, seed: str = SEED,
                          split_out: str | None = "split", fold_out: str | None = "fold",
                          bucket_rows: int = BUCKET_ROWS, strict: bool = True) -> DataFrame:
    """Both the split and the fold from one ranking pass.

    A row with a null class is in no part and no fold: it comes out with nulls
    there.  Class sizes that the library refuses raise ``ClassTooSmall``, unless
    ``strict`` is off (then a class of one row goes where its quota falls).
    """
    # one row per class, written once; its row count and the number of
    # (class, bucket) offsets it implies are counted before any broadcast
    classed = df.where(F.col(class_col).isNotNull())
    plan = cut_lineage(class_plan(classed, class_col, test_size)
                       .withColumn("_bits", bucket_bits("n", bucket_rows)), "classplan")
    sizes = plan.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.min("n").alias("least"), F.max("n").alias("most"),
                     F.sum(F.pow(F.lit(2.0), F.col("_bits"))).alias("pairs")).first()
    if strict and sizes["k"]:
        if split_out:
            check_split(sizes, test_size)
        if fold_out:
            check_folds(sizes, n_folds)
    plan = plan.drop("n")
    plan = F.broadcast(plan) if sizes["k"] <= MAX_BROADCAST_ROWS else plan
    out = ranked_in_class(classed.join(plan, class_col), class_col, id_col, seed, bits=F.col("_bits"),
                          broadcast_offsets=(sizes["pairs"] or 0) <= MAX_BROADCAST_ROWS)
    unclassed = df.where(F.col(class_col).isNull())
    if split_out:
        out = out.withColumn(split_out, F.when(F.col("rank_in_class") <= F.col("n_train_quota"), F.lit("train"))
                             .otherwise(F.lit("test")))
        unclassed = unclassed.withColumn(split_out, F.lit(None).cast("string"))
    if fold_out:
        out = out.withColumn(fold_out, ((F.col("_offset") + F.col("rank_in_class") - 1) % n_folds).cast("int"))
        unclassed = unclassed.withColumn(fold_out, F.lit(None).cast("int"))
    columns = [*df.columns, *(c for c in (split_out, fold_out) if c)]
    return out.select(columns).union(unclassed.select(columns))


def seeded_order(df: DataFrame, id_col: str = "doc_id", seed: str = SEED, out: str = "position",
                 bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, position): 1-based position of every row in the seeded md5 order (a repeatable shuffle).

    One global rank, cut into md5 buckets of about ``bucket_rows`` rows (the
    bits follow the row count, counted first); the offsets table has at most
    2 N / bucket_rows + 1 rows.
    """
    n = df.count()
    bits = max(0, min(32, math.ceil(math.log2(max(n, 1) / bucket_rows)))) if n > bucket_rows else 0
    d = df.select(id_col).withColumn("_h", order_key(id_col, seed))
    r = bucketed_rank(d, [], [F.col("_h"), F.col(id_col)], md5_bucket("_h", bits), out=out,
                      broadcast_offsets=(1 << bits) <= MAX_BROADCAST_ROWS)
    return r.select(id_col, out)


def split_sizes(df: DataFrame, split_col: str = "split") -> DataFrame:
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n"))
