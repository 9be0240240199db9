"""One-vs-rest ROC points and areas with cumulative windows.

For class k the rows are ranked by a score, equal scores merged into one
point; true and false positive counts are running sums in descending score
order.  A point is kept when the step to it differs from the step after it
(collinear points dropped), the first and last points are always kept and the
origin is added with a null threshold.  The area is the trapezoid sum, equal
to the Mann-Whitney count: ``sum(neg * (tp_cum - pos / 2)) / (P * N)``.

The running sums run over range partitions of (class, score), so a class
holding most rows is spread over many tasks of about equal size whatever the
distribution of its scores; the neighbour of each point comes from an
equi-join on (class, index + 1), not from a window over the whole class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from babelcask.functions.scores import margin
from babelcask.operators.ranking import range_running_sums
from babelcask.session import cut_lineage

DIGITS = 6


def one_vs_rest(df: DataFrame, scores: str, y: str, k: int, use_margin: bool = True,
                id_col: str = "doc_id") -> DataFrame:
    """(id, class, score, pos) for every row and every class index in ``0..k-1``."""
    per_class = [F.struct(F.lit(i).alias("class"),
                          (margin(F.col(scores), i) if use_margin else F.element_at(F.col(scores), i + 1))
                          .alias("score"))
                 for i in range(k)]
    out = df.select(id_col, F.col(y).alias("_y"), F.explode(F.array(*per_class)).alias("_c"))
    return out.select(id_col, F.col("_c.class").alias("class"), F.col("_c.score").alias("score"),
                      F.when(F.col("_y") == F.col("_c.class"), 1).otherwise(0).cast("long").alias("pos"))


# Rows per range partition of the running sums.
ROWS_PER_PART = 1 << 20


def roc_table(ovr: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """(class, score, p, ng, tp, fp, idx): one row per distinct score with cumulative counts, written once.

    The points and the areas both read this table, so the running sums are
    computed once per score table.  The rows before merging bound the number
    of range partitions.
    """
    merged = ovr.groupBy("class", "score").agg(F.sum("pos").alias("p"), F.sum(1 - F.col("pos")).alias("ng"))
    n_parts = max(1, -(-ovr.count() // rows_per_part))
    return cut_lineage(range_running_sums(
        merged, ["class"], [F.col("score").desc()],
        {"tp": F.col("p"), "fp": F.col("ng"), "idx": F.lit(1).cast("long")}, n_parts=n_parts, prefix="roc"), "roctable")


def _totals(table: DataFrame) -> DataFrame:
    """Positives and negatives per class: the last running sums."""
    return table.groupBy("class").agg(F.max("tp").alias("P"), F.max("fp").alias("N"))


def roc_points(table: DataFrame) -> DataFrame:
    """(class, threshold, tp, fp, fpr, tpr) of a ``roc_table``, after dropping collinear points."""
    nxt = table.select("class", (F.col("idx") - 1).alias("idx"),
                       F.col("p").alias("p_next"), F.col("ng").alias("ng_next"))
    tot = _totals(table)
    kept = (table.join(nxt, ["class", "idx"], "left")
            .where((F.col("idx") == 1) | F.col("p_next").isNull()
                   | (F.col("p_next") != F.col("p")) | (F.col("ng_next") != F.col("ng")))
            .select("class", F.col("score").cast("double").alias("threshold"), "tp", "fp"))
    origin = tot.select(
        "class", F.lit(None).cast("double").alias("threshold"),
        F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"))
    allp = kept.unionByName(origin).join(F.broadcast(tot), "class")  # one row per class
    return allp.select(
        "class", "threshold", "tp", "fp",
        F.when(F.col("N") > 0, F.round(F.col("fp") / F.col("N"), DIGITS)).alias("fpr"),
        F.when(F.col("P") > 0, F.round(F.col("tp") / F.col("P"), DIGITS)).alias("tpr"))


def roc_auc(table: DataFrame) -> DataFrame:
    """(class, auc) of a ``roc_table``; null when a class has no positive or no negative row."""
    area = table.groupBy("class").agg(
        F.sum(F.col("ng") * (F.col("tp") - F.col("p") / 2.0)).alias("_a"), F.max("tp").alias("P"), F.max("fp").alias("N"))
    return area.select(
        "class",
        F.when((F.col("P") > 0) & (F.col("N") > 0),
               F.round(F.col("_a") / (F.col("P").cast("double") * F.col("N").cast("double")), DIGITS)).alias("auc"))
