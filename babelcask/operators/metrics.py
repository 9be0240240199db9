"""Classification metrics from one confusion table.

Everything starts from ``groupBy(keys, y, yhat).count()``: K x K rows per key,
one shuffle, pre-aggregated map-side.  Ratios with a zero denominator are 0
(the ``zero_division=0`` rule).  Results are rounded to 6 digits.
``by`` is any grouping key (fold, candidate, language...), so one call gives
the metrics of many evaluations at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from babelcask.functions.scores import MICRO, nll_micro

DIGITS = 6


def _ratio(num, den) -> Column:
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def confusion(df: DataFrame, y: str = "y", yhat: str = "yhat", by=()) -> DataFrame:
    return df.groupBy(*by, F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(F.count(F.lit(1)).alias("n"))


def accuracy(df: DataFrame, y: str = "y", yhat: str = "yhat", by=()) -> DataFrame:
    hit = F.when(F.col(y) == F.col(yhat), 1).otherwise(0)
    return df.groupBy(*by).agg(F.round(F.avg(hit), DIGITS).alias("accuracy"))


def class_counts(conf: DataFrame, by=()) -> DataFrame:
    """(by..., class, tp, support, predicted) for every class in truth or prediction."""
    as_true = conf.select(*by, F.col("y").alias("class"),
                          F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0).alias("tp"),
                          F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"))
    as_pred = conf.select(*by, F.col("yhat").alias("class"), F.lit(0).cast("long").alias("tp"),
                          F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"))
    return (as_true.unionByName(as_pred).groupBy(*by, "class")
            .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted")))


def _with_prf(counts: DataFrame) -> DataFrame:
    return (counts
            .withColumn("precision", _ratio(F.col("tp"), F.col("predicted")))
            .withColumn("recall", _ratio(F.col("tp"), F.col("support")))
            .withColumn("f1", _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))))


def class_report(df: DataFrame, y: str = "y", yhat: str = "yhat", by=()) -> DataFrame:
    """Per class: precision, recall, F1, support."""
    per = _with_prf(class_counts(confusion(df, y, yhat, by), by))
    return per.select(*by, "class", *[F.round(c, DIGITS).alias(c) for c in ("precision", "recall", "f1")],
                      F.col("support").cast("long").alias("support"))


def full_report(df: DataFrame, classes: DataFrame, y: str = "y", yhat: str = "yhat", by=()) -> DataFrame:
    """``class_report`` over every class of ``classes(value)``, for each ``by``; ``in_data``: a row has or predicts it.

    A class without rows has zeros and support 0.  The classes are laid out per
    ``by`` value from the report itself (K rows each), so no data row moves.
    """
    per = _with_prf(class_counts(confusion(df, y, yhat, by), by))
    grid = classes.select(F.col("value").alias("class"))
    if by:
        names = grid.agg(F.array_sort(F.collect_list("class")).alias("_k"))     # one row: the dictionary
        grid = per.select(*by).distinct().join(F.broadcast(names)).select(*by, F.explode("_k").alias("class"))
    out = grid.join(per, [*by, "class"], "left")
    return out.select(
        *by, "class", *[F.coalesce(F.round(c, DIGITS), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")],
        F.coalesce(F.col("support").cast("long"), F.lit(0)).alias("support"), F.col("tp").isNotNull().alias("in_data"))


def weighted_prf(df: DataFrame, y: str = "y", yhat: str = "yhat", by=()) -> DataFrame:
    """Accuracy and support-weighted precision, recall, F1, per ``by``."""
    per = _with_prf(class_counts(confusion(df, y, yhat, by), by))
    sup = F.sum("support")
    return per.groupBy(*by).agg(
        F.round(F.sum("tp") / sup, DIGITS).alias("accuracy"),
        F.round(F.sum(F.col("precision") * F.col("support")) / sup, DIGITS).alias("precision"),
        F.round(F.sum(F.col("recall") * F.col("support")) / sup, DIGITS).alias("recall"),
        F.round(F.sum(F.col("f1") * F.col("support")) / sup, DIGITS).alias("f1"),
    )


def report_totals(df: DataFrame, y: str = "y", yhat: str = "yhat", by=()) -> DataFrame:
    """The report's last rows: accuracy, macro avg, weighted avg."""
    per = _with_prf(class_counts(confusion(df, y, yhat, by), by))
    sup = F.sum("support")
    macro = per.groupBy(*by).agg(
        F.lit("macro avg").alias("row"),
        *[F.round(F.avg(c), DIGITS).alias(c) for c in ("precision", "recall", "f1")],
        sup.cast("long").alias("support"))
    weighted = per.groupBy(*by).agg(
        F.lit("weighted avg").alias("row"),
        *[F.round(F.sum(F.col(c) * F.col("support")) / sup, DIGITS).alias(c) for c in ("precision", "recall", "f1")],
        sup.cast("long").alias("support"))
    acc = per.groupBy(*by).agg(
        F.lit("accuracy").alias("row"),
        F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"),
        F.round(F.sum("tp") / sup, DIGITS).alias("f1"), sup.cast("long").alias("support"))
    return acc.unionByName(macro).unionByName(weighted)


def metrics_long(df: DataFrame, y: str = "y", yhat: str = "yhat", by=()) -> DataFrame:
    """(by..., metric, value) rows of accuracy, precision, recall, f1."""
    w = weighted_prf(df, y, yhat, by)
    return w.select(*by, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
        for m in ("accuracy", "precision", "recall", "f1")])).alias("_m")).select(*by, "_m.metric", "_m.value")


def eval_loss(df: DataFrame, scores: str = "scores", y: str = "y_id", by=()) -> DataFrame:
    """Mean cross-entropy of the scores (softmax over classes), in nats."""
    return df.groupBy(*by).agg(
        F.round(F.avg(nll_micro(F.col(scores), F.col(y))) / F.lit(MICRO), DIGITS).alias("eval_loss"))
