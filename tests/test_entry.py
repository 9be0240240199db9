import os

import duckdb
import pytest

import __spark_entry__ as E
from data_paths import SMALL

TABLES = ["documents", "labels", "embeddings", "conversations"]
FAST = ["corpus_clean", "split_stratified", "kfold_sizes", "gram_counts", "cascade_eval", "class_report",
        "roc_points", "cv_cascade", "predict", "eval_loss", "best_candidate", "roc_auc_embeddings", "tsv_rejects",
        "best_candidate_loss", "predict_best", "token_sequences", "class_report_full", "lr_slots", "lr_losses",
        "langid_metrics", "cv_pooled_report_language", "roc_auc_baseline", "cascade_results", "baseline_reload"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["doc_id", "language", "predicted_language", "label", "predicted_label"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    return f"{round(v, 6):.6f}" if isinstance(v, float) else ("∅" if v is None else str(v))


def _compare(spark, name, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    df = E.queries()[name](spark, folder)
    rel = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(dcols)
    order = sorted(df.columns)
    s = sorted(tuple(_norm(r[c]) for c in order) for r in df.collect())
    idx = [dcols.index(c) for c in order]
    d = sorted(tuple(_norm(r[i]) for i in idx) for r in rel.fetchall())
    assert s == d
    return s


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, name):
    _compare(spark, name, SMALL)


@pytest.fixture(scope="module")
def lone_language(spark, tmp_path_factory):
    """The small tables with one test document in a language of its own: a class without training rows."""
    folder = str(tmp_path_factory.mktemp("lone"))
    one = E.queries()["split_stratified"](spark, SMALL).filter("split = 'test'").orderBy("doc_id").first()["doc_id"]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE TABLE {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    con.execute(f"UPDATE documents SET lang = 'xx' WHERE doc_id = {one}")
    for t in TABLES:
        con.execute(f"COPY {t} TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("name", ["langid_model", "class_scores", "cascade_eval", "cv_cascade", "language_report",
                                  "cascade_summary", "predict"])
def test_class_without_training_rows_matches_oracle(spark, lone_language, name):
    rows = _compare(spark, name, lone_language)
    assert rows and (name == "predict" or name == "cascade_summary" or any("xx" in r for r in rows))
