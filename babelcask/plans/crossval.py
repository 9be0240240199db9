"""Stratified k-fold evaluation of the baseline and the cascade.

The reference refits a fresh model per fold.  Naive Bayes counts add up, so
here the counts are taken once per (key, fold) and the model of fold f is
"all counts minus fold f" (see ``bayes.fit_folds``): one counting pass fits
all folds, and each row is scored by the model of its own fold in one join.
The out-of-fold predictions of all rows then pool into one table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from babelcask.operators import bayes, metrics
from babelcask.plans.cascade import CascadeModel, Corpus, score_cascade


def sentiment_fold_counts(cp: Corpus) -> bayes.FoldCounts:
    """((language, gram) -> label) counts of every fold: the one pass over the count table."""
    return bayes.fold_counts(cp.features, "label", cp.dictionary("label").classes, cp.config.n_folds,
                             keys=("language", "gram"))


def cv_baseline(cp: Corpus, sc: bayes.FoldCounts | None = None) -> DataFrame:
    """(doc_id, fold, label, predicted_label, label_id, predicted_label_id, sent_scores).

    The fold counts are the cascade's sentiment fold counts with the language
    summed out (given or counted here).
    """
    sd = cp.dictionary("label")
    fc = bayes.fold_counts_marginal(sc or sentiment_fold_counts(cp), "language")
    m = bayes.fold_model(fc, cp.docs, "label", cp.config.alpha)
    s = bayes.score(m, cp.features, id_cols=["doc_id", "fold", "label"], out="sent_scores")
    return s.select("doc_id", "fold", "label",
                    sd.decode(bayes.predict_ids("sent_scores")).alias("predicted_label"),
                    sd.encode("label").alias("label_id"),
                    bayes.predict_ids("sent_scores").alias("predicted_label_id"), "sent_scores")


def cv_cascade(cp: Corpus, sc: bayes.FoldCounts | None = None) -> DataFrame:
    """Out-of-fold cascade: language, then sentiment crossed with the predicted language."""
    ld, sd = cp.dictionary("language"), cp.dictionary("label")
    # one pass over the count table; the language fold counts are row sums of the sentiment ones
    sc = sc or sentiment_fold_counts(cp)
    lc = bayes.fold_counts_by_key(sc, "language", ld.classes)
    lm = bayes.fold_model(lc, cp.docs, "language", cp.config.alpha)
    sm = bayes.fold_model(sc, cp.docs, "label", cp.config.alpha)
    s = score_cascade(CascadeModel(lm, sm, ld, sd), cp.features, carry=("label", "language"))
    return s.select("doc_id", "fold", "language", "predicted_language", "label", "predicted_label",
                    "lang_scores", "sent_scores")


def fold_metrics(preds: DataFrame, y: str = "label", yhat: str = "predicted_label") -> DataFrame:
    """(fold, metric, value): accuracy and weighted precision, recall, F1 of each fold."""
    return metrics.metrics_long(preds, y, yhat, by=["fold"])


def mean_metrics(fold_long: DataFrame) -> DataFrame:
    """(metric, value): unweighted mean over folds."""
    return fold_long.groupBy("metric").agg(F.round(F.avg("value"), metrics.DIGITS).alias("value"))
