import pytest
from pyspark.sql import functions as F

from babelcask.operators import bayes, trainer
from babelcask.plans import catalog, cascade, choice
from babelcask.sources import models
from babelcask.sources.tables import corpus
from babelcask.streaming.predict_stream import DOC_SCHEMA, read_predictions, start_prediction_stream
from data_paths import SMALL


def test_language_identification_beats_majority(spark):
    ev = catalog.cascade_eval_df(spark, SMALL)
    r = ev.agg(F.avg((F.col("language") == F.col("predicted_language")).cast("int"))).first()[0]
    top = ev.groupBy("language").count().agg(F.max("count")).first()[0] / ev.count()
    assert r > top


def test_predict_empty_and_duplicates(spark):
    m = catalog.cascade_model(spark, SMALL)
    empty = spark.createDataFrame([], DOC_SCHEMA)
    assert cascade.predict(m, empty).count() == 0
    rows = [(1, "the same text"), (2, "the same text"), (2, "the same text"), (2, "un autre texte"), (3, None), (None, "x"), (None, "x")]
    out = cascade.predict(m, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in out) == sorted((str(a), str(b)) for a, b in rows)
    same = {(r["predicted_language"], r["predicted_sentiment"]) for r in out if r["text"] == "the same text"}
    assert len(same) == 1 and None not in same.pop()
    assert [tuple(r)[2:] for r in out if r["text"] is None] == [(None, None)]


def test_save_load_and_guard(spark, scratch):
    m = catalog.cascade_model(spark, SMALL)
    path = models.save_cascade(m, f"{scratch}/model")
    loaded = models.load_cascade(spark, path)
    docs = spark.createDataFrame([(1, "ein kurzer satz"), (2, "une phrase courte")], DOC_SCHEMA)
    a = sorted(tuple(r) for r in cascade.predict(m, docs).collect())
    b = sorted(tuple(r) for r in cascade.predict(loaded, docs).collect())
    assert a == b
    with pytest.raises(models.ModelNotTrained, match="Model not trained"):
        models.load_cascade(spark, f"{scratch}/nothing-here")


def test_stream_equals_batch(spark, scratch):
    m = catalog.cascade_model(spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(f"{scratch}/in")
    q = start_prediction_stream(spark, m, f"{scratch}/in", f"{scratch}/out", f"{scratch}/ckpt",
                                max_files_per_trigger=1)
    q.awaitTermination(300)
    out = read_predictions(spark, f"{scratch}/out")
    cols = ["doc_id", "predicted_language", "predicted_sentiment"]
    got = sorted(tuple(r) for r in out.select(cols).collect())
    want = sorted(tuple(r) for r in cascade.predict(m, docs).select(cols).collect())
    assert got == want
    assert out.select("batch_id").distinct().count() == 3   # one folder per micro-batch
    # a restart from the same checkpoint finds every batch done: nothing is added
    q = start_prediction_stream(spark, m, f"{scratch}/in", f"{scratch}/out", f"{scratch}/ckpt",
                                max_files_per_trigger=1)
    q.awaitTermination(300)
    assert sorted(tuple(r) for r in read_predictions(spark, f"{scratch}/out").select(cols).collect()) == want


def test_fused_scoring_by_shuffle_equals_broadcast(spark):
    m = catalog.cascade_model(spark, SMALL)
    test = catalog.corpus_of(spark, SMALL).features.where(F.col("split") == "test")
    cols = ["doc_id", "lang_scores", "predicted_language", "sent_scores", "predicted_label"]
    for gold in (False, True):
        a = cascade.score_cascade(m, test, carry=("label", "language"), gold_language=gold)
        b = cascade.score_cascade(m, test, carry=("label", "language"), gold_language=gold, broadcast_limit=0)
        assert sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))
        c = cascade._score_two_pass(m, test, ("label", "language"), gold)
        assert sorted(map(str, a.select(cols).collect())) == sorted(map(str, c.select(cols).collect()))
    # one read of the counts, moved once to the fitted table and once, summed, to their documents
    plan = b._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [doc_id") == 1


def test_fold_models_by_shuffle_equal_broadcast(spark):
    cp = catalog.corpus_of(spark, SMALL)
    ld, sd = cp.dictionary("language"), cp.dictionary("label")
    sc = catalog.sentiment_fold_counts(spark, SMALL)
    lm = bayes.fold_model(bayes.fold_counts_by_key(sc, "language", ld.classes), cp.docs, "language")
    m = cascade.CascadeModel(lm, bayes.fold_model(sc, cp.docs, "label"), ld, sd)
    got = [sorted(map(str, cascade.score_cascade(m, cp.features, carry=("label", "language"), broadcast_limit=limit)
                      .select("doc_id", "fold", "lang_scores", "sent_scores").collect())) for limit in (None, 0)]
    assert got[0] == got[1]


def test_text_moves_once_without_a_broadcast(spark):
    for limit, joins in ((None, "BroadcastHashJoin"), (0, "SortMergeJoin")):
        plan = corpus(spark, SMALL, n_parts=6, broadcast_bytes=limit)._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(doc_id" in line]
        assert joins in plan and len(moved) == (1 if limit is None else 2) and "ENSURE_REQUIREMENTS" not in "".join(moved)
    rows = [sorted(map(str, corpus(spark, SMALL, n, b).collect())) for n, b in ((None, None), (6, None), (6, 0))]
    assert rows[0] == rows[1] == rows[2]


def test_choice_by_loss_and_by_f1(spark):
    cp = catalog.corpus_of(spark, SMALL)
    counts = catalog.baseline_counts(spark, SMALL)
    for by, pick in (("eval_loss", min), ("f1", max)):
        c = choice.choose_baseline(cp, counts, (1, 3, 9), by)
        rows = c.candidates.collect()
        best = [r for r in rows if r["is_best"]]
        assert len(best) == 1 and best[0][by] == pick(r[by] for r in rows) and c.alpha == best[0]["alpha"]
    assert c.model.table.count() == counts.vocab


def test_baseline_and_trainer_come_back(spark, scratch):
    m, sd = catalog.baseline_model(spark, SMALL)
    back, classes = models.load_baseline(spark, models.save_baseline(m, f"{scratch}/base"))
    test = catalog.corpus_of(spark, SMALL).features.where(F.col("split") == "test")
    assert classes == sd
    assert sorted(map(str, bayes.score(back, test).collect())) == sorted(map(str, bayes.score(m, test).collect()))
    t = catalog._lr_model(spark, SMALL)
    loaded = models.load_trained(spark, models.save_trained(t, f"{scratch}/lr"))
    vecs = catalog._lr_vectors(spark, SMALL).where(F.col("split") == "test")
    got = [sorted(map(str, x.predict(vecs).select("doc_id", "predicted_label").collect())) for x in (t, loaded)]
    assert got[0] == got[1] and loaded.losses == t.losses
    assert len(t.losses) > 3 and all(b < a for a, b in zip(t.losses, t.losses[1:], strict=False))
    # a folder that was begun and not finished is no model
    spark.range(1).write.parquet(f"{scratch}/half/baseline/table")
    with pytest.raises(models.ModelNotTrained, match="baseline/meta"):
        models.load_baseline(spark, f"{scratch}/half")
    for load in (models.load_baseline, models.load_trained):
        with pytest.raises(models.ModelNotTrained):
            load(spark, f"{scratch}/nothing-here")


def test_trainer_beats_the_majority_and_reads_no_text(spark):
    vecs = catalog._lr_vectors(spark, SMALL)
    assert dict(vecs.dtypes)["features"] == "vector"
    scored = catalog._lr_model(spark, SMALL).predict(vecs.where(F.col("split") == "train"))
    hit = scored.agg(F.avg((F.col("label") == F.col("predicted_label")).cast("int"))).first()[0]
    assert hit > 0.9


def test_unwritten_sink_has_no_rows(spark, scratch):
    got = read_predictions(spark, f"{scratch}/never")
    assert got.count() == 0 and got.columns == ["doc_id", "text", "predicted_language", "predicted_sentiment", "batch_id"]


def test_centroids_are_counted_first(spark):
    df = spark.createDataFrame([([1.0, 2.0], 0), ([3.0, 4.0], 0), ([5.0, 6.0], 1), (None, 1)], "x array<double>, y int")
    labels, means = trainer.class_centroids(df, "x", "y")
    assert labels == [0, 1] and means.tolist() == [[2.0, 3.0], [5.0, 6.0]]
    with pytest.raises(ValueError, match="limit"):
        trainer.class_centroids(df, "x", "y", max_bytes=8)
