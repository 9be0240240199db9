"""Model choice on a held-out part of the training rows.

The training rows of one fold are the validation part; the candidates are
fitted on the other training rows.  One counting pass serves all candidates:
their scores lie side by side in one array per gram, and one join and one
aggregation score every validation document under every candidate.  The
candidate of least loss (or best weighted F1; ties: the first) is fitted again
on all training rows and handed on.  The test rows take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from babelcask.operators import bayes, metrics
from babelcask.operators.encode import ClassDictionary
from babelcask.plans.cascade import Corpus

VALIDATION_FOLD = 0


@dataclass
class Choice:
    """(candidate, alpha, eval_loss, accuracy, f1, is_best) per candidate, and the chosen model."""
    candidates: DataFrame
    alpha: int | float
    model: bayes.NaiveBayesModel
    classes: ClassDictionary


def candidate_scores(cp: Corpus, alphas, validation_fold: int = VALIDATION_FOLD) -> DataFrame:
    """(doc_id, label, candidate, sent_scores) of the validation rows under every candidate."""
    classes = cp.dictionary("label")
    train, held = F.col("split") == "train", F.col("fold") == validation_fold
    counts = bayes.count(cp.features.where(train & ~held), cp.docs.where(train & ~held), "label", classes.classes)
    return bayes.score(counts.candidates(alphas), cp.features.where(train & held), id_cols=["doc_id", "label"],
                       out="sent_scores", all_slices=True)


def choose_baseline(cp: Corpus, counts: bayes.NaiveBayesCounts, alphas, by: str = "eval_loss",
                    validation_fold: int = VALIDATION_FOLD) -> Choice:
    """Choice among smoothing values; ``counts``: of all training rows, for the final fit; ``by``: eval_loss or f1."""
    classes = cp.dictionary("label")
    scored = candidate_scores(cp, alphas, validation_fold).select(
        "candidate", "label", "sent_scores", classes.encode("label").alias("label_id"),
        classes.decode(bayes.predict_ids("sent_scores")).alias("predicted_label"))
    loss = metrics.eval_loss(scored, "sent_scores", "label_id", by=["candidate"])
    prf = metrics.weighted_prf(scored, "label", "predicted_label", by=["candidate"])
    rows = loss.join(prf, "candidate").orderBy("candidate").collect()      # one row per candidate
    sign = 1 if by == "eval_loss" else -1
    best = min(rows, key=lambda r: (sign * r[by], r["candidate"]))["candidate"]
    table = cp.spark.createDataFrame(
        [(r["candidate"], float(alphas[r["candidate"]]), r["eval_loss"], r["accuracy"], r["f1"], r["candidate"] == best)
         for r in rows], "candidate int, alpha double, eval_loss double, accuracy double, f1 double, is_best boolean")
    return Choice(table, alphas[best], counts.model(alphas[best]), classes)
