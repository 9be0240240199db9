"""Running sums and ranks inside large groups without one task per group.

A window ``partitionBy(group).orderBy(...)`` puts a whole group in one task;
with a handful of classes, one of them may hold a third of all rows.  Here
each group is cut into ordered buckets by a monotone bucket expression.  The
window runs per (group, bucket); a small table of per-bucket totals, prefix
summed, supplies the offset of each bucket.  Result equals the plain window.

Two kinds of bucket: a hash prefix (uniform by construction, for orders on an
md5 digest), and range partitions (``range_running_sums``) for orders on
values of unknown distribution, such as scores, where any fixed value scale
could put most rows in a few buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from babelcask.session import cut_lineage, shuffle_partitions


def md5_bucket(hex_digest, bits=16) -> Column:
    """Bucket from the first ``bits`` bits (0 to 32) of an md5 hex digest; monotone in the digest's order.

    ``bits`` may be a column: a per-group resolution, constant inside each group.
    """
    h = F.col(hex_digest) if isinstance(hex_digest, str) else hex_digest
    top = F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")          # first 32 bits
    b = F.lit(bits) if isinstance(bits, int) else bits
    # dividing by a power of two is exact in a double; the cast floors the positive quotient
    return (top / F.pow(F.lit(2.0), F.lit(32) - b)).cast("bigint")


def bucketed_running_sums(df: DataFrame, group_cols: list[str], order_cols: list[Column],
                          bucket: Column, sums: dict[str, Column],
                          broadcast_offsets: bool = True) -> DataFrame:
    """Add running sums (rows from the group's start through the current row).

    ``order_cols`` must give a total order inside each group and ``bucket``
    must never decrease along it.  ``broadcast_offsets`` may be set only when
    the number of (group, bucket) pairs is known to be small: the split counts
    it before ranking; range buckets have at most partitions + groups.
    """
    b = "_bkt"
    d = df.withColumn(b, bucket)
    for name, expr in sums.items():
        d = d.withColumn(f"_{name}_v", expr)
    local = (Window.partitionBy(*group_cols, b).orderBy(*order_cols)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    for name in sums:
        d = d.withColumn(f"_{name}_loc", F.sum(f"_{name}_v").over(local))
    totals = d.groupBy(*group_cols, b).agg(*[F.sum(f"_{n}_v").alias(f"_{n}_tot") for n in sums])
    before = Window.partitionBy(*group_cols).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group_cols, b, *[
        F.coalesce(F.sum(f"_{n}_tot").over(before), F.lit(0)).alias(f"_{n}_off") for n in sums])
    if broadcast_offsets:
        offsets = F.broadcast(offsets)
    out = d.join(offsets, [*group_cols, b])
    for name in sums:
        out = out.withColumn(name, F.col(f"_{name}_loc") + F.col(f"_{name}_off"))
    drop = [b] + [f"_{n}_{s}" for n in sums for s in ("v", "loc", "off")]
    return out.drop(*drop)


def bucketed_rank(df: DataFrame, group_cols: list[str], order_cols: list[Column], bucket: Column,
                  out: str = "rank", broadcast_offsets: bool = True) -> DataFrame:
    """Exact ``row_number()`` within each group, computed per bucket."""
    return bucketed_running_sums(df, group_cols, order_cols, bucket, {out: F.lit(1).cast("long")},
                                 broadcast_offsets=broadcast_offsets)


def range_running_sums(df: DataFrame, group_cols: list[str], order_cols: list[Column],
                       sums: dict[str, Column], n_parts: int | None = None,
                       prefix: str = "ranged") -> DataFrame:
    """``bucketed_running_sums`` with range partitions as the buckets.

    The rows are range-partitioned on (group, order): the boundaries come from
    a sample of the keys, so each partition holds about the same number of
    rows whatever the distribution of the values, and partition numbers rise
    with the order, so the partition number is a monotone bucket.  The
    assignment is written once to the checkpoint folder, so the local sums and
    the bucket offsets read the same buckets even if a stage is recomputed.
    The offsets table has at most partitions + groups rows.
    """
    n = n_parts or shuffle_partitions(df.sparkSession)
    d = df.repartitionByRange(n, *[F.col(g) for g in group_cols], *order_cols)
    d = cut_lineage(d.withColumn("_range_bkt", F.spark_partition_id()), prefix)
    out = bucketed_running_sums(d, group_cols, order_cols, F.col("_range_bkt"), sums)
    return out.drop("_range_bkt")


def numbered(df: DataFrame, order_cols: list[str], out: str = "idx", n_parts: int | None = None,
             prefix: str = "numbered") -> DataFrame:
    """``df`` with a dense 0-based number along ``order_cols``, which must give a total order.

    The rows are range-partitioned and sorted inside their partitions, so a
    row's number is its place in its partition plus the rows of the earlier
    partitions: one range shuffle, no window over all rows.  Partition and
    place are written once with the row (a recomputed stage cannot renumber);
    the offsets table has one row per partition.
    """
    n = n_parts or shuffle_partitions(df.sparkSession)
    order = [F.col(c) for c in order_cols]
    # the low 33 bits of a monotonic id count the rows of its partition
    placed = cut_lineage(
        df.repartitionByRange(n, *order).sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), prefix)
    before = Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
               .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    return (placed.join(F.broadcast(offsets), "_part")
            .withColumn(out, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before"))
