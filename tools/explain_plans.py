"""Write the physical plans of the main steps to docs/PLANS.md.

Usage: python tools/explain_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from babelcask.operators import bayes, curves, trainer  # noqa: E402
from babelcask.operators.features import gram_counts  # noqa: E402
from babelcask.plans import cascade, catalog  # noqa: E402
from babelcask.session import build_session, work_partitions  # noqa: E402
from babelcask.sources.tables import corpus  # noqa: E402


def plan(df) -> str:
    text = df._jdf.queryExecution().executedPlan().toString()
    text = re.sub(r"#\d+L?", "", text)
    text = re.sub(r"Location: [^,]+, ", "", text)
    return "\n".join(line[:160] for line in text.splitlines())


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 8)
    cp = catalog.corpus_of(spark, sf_dir)
    model = catalog.cascade_model(spark, sf_dir)
    test = cp.features.where(F.col("split") == "test")
    train = cp.features.where(F.col("split") == "train")
    sd = cp.dictionary("label")
    n = work_partitions(corpus(spark, sf_dir))
    roc = curves.roc_table(curves.one_vs_rest(catalog.cascade_eval_df(spark, sf_dir), "sent_scores", "label_id",
                                              model.sent_dict.size))
    steps = [
        ("Featurise, labels broadcast: the labelled text is hash-partitioned by doc_id once, counted without another shuffle",
         gram_counts(corpus(spark, sf_dir, n), carry=("label", "language"), partition=False)),
        ("Featurise, broadcast off: both sides partitioned alike, one exchange of the text, none for the counts",
         gram_counts(corpus(spark, sf_dir, n, 0), carry=("label", "language"), partition=False)),
        ("Split: the per-document table, from the corpus without its text and without grams",
         corpus(spark, sf_dir).select("doc_id", "label", "language")),
        ("Fit: one aggregation of class sums into an array (partial aggregation before the shuffle)",
         bayes.slot_sums(train.where(F.col("gram").isNotNull()), ["gram"], sd.encode("label"), F.col("n"), sd.size)),
        ("Cascade scoring, fused: bucketed count table, broadcast fitted table, no exchange",
         cascade.score_cascade(model, test, carry=("label", "language"))),
        ("Cascade scoring, fused, above the broadcast limit: one shuffle of the counts on the salted gram",
         cascade.score_cascade(model, test, carry=("label", "language"), broadcast_limit=0)),
        ("Count table joined to the per-document table: both bucketed by doc_id",
         cp.features.groupBy("split").agg(F.sum("n"))),
        ("Five folds: one row per gram with all folds' scores, the row's fold picks its slice",
         bayes.score(bayes.fold_model(bayes.fold_counts_marginal(catalog.sentiment_fold_counts(spark, sf_dir), "language"),
                                      cp.docs, "label"), cp.features, id_cols=["doc_id", "fold", "label"])),
        ("Sparse vectors: (document, slot) counts and vectors inside the documents' buckets", trainer.slot_counts(cp.features)),
        ("ROC points from the written running sums: the neighbour by an equi-join, no window", curves.roc_points(roc)),
        ("Areas from the same table", curves.roc_auc(roc)),
    ]
    out = ["# Physical plans (sf0.01, local[8])", "",
           "Generated by `tools/explain_plans.py`; expression ids removed.", ""]
    for title, df in steps:
        out += [f"## {title}", "", "```", plan(df), "```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(out))
    print(path)


if __name__ == "__main__":
    main()
