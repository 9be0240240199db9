"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a ``groupBy`` minimum (combined before the shuffle) and an
equi-join, so a hub with very many links is split by the skew join and no
group is gathered in a task.  Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from babelcask.llm.work import Staging


def _both_ways(links: DataFrame) -> DataFrame:
    return links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Each vertex's larger neighbours are linked to the least of its neighbours and itself."""
    near = _both_ways(links)
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return (near.filter("b > a").join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """Each vertex's smaller neighbours and itself are linked to the least of them (``a > b`` in ``links``)."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(links: DataFrame, staging: Staging, name: str) -> DataFrame:
    """``links(a, b)`` -> ``(a, b)``: every linked vertex but the roots, with its component's least vertex."""
    now = staging.write(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        f"{name}_0")
    seen, step = None, 0
    while True:
        step += 1
        now = staging.write(_small_star(_large_star(now)), f"{name}_{step}")
        staging.drop(f"{name}_{step - 1}")
        # a fixed point has the same links: their number and an order-free digest
        mark = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == seen:
            return now
        seen = mark
