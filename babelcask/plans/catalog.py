"""Registered queries: one per operator of the inventory, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the given tables (or what Spark derives from them) in
full: whole tables, whole texts.  The featurised corpus and the fitted models
are shared between the queries of one session (they are materialised tables);
``clear()`` forgets them, so a timed run can start cold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from babelcask.functions.text import prefixed
from babelcask.operators import bayes, curves, metrics, trainer
from babelcask.operators.encode import ClassDictionary, Dictionary
from babelcask.operators.features import token_sequences, token_stats
from babelcask.operators.split import assign_split_and_fold, seeded_order, split_sizes
from babelcask.plans import cascade, choice, crossval
from babelcask.plans.cascade import CascadeConfig, Corpus
from babelcask.session import cut_lineage
from babelcask.sources import models, tables, tsv
from babelcask.streaming.predict_stream import read_predictions, start_prediction_stream

MAX_TOKENS = 512
CANDIDATE_ALPHAS = (1, 2, 5)

_MEMO: dict = {}


def clear() -> None:
    _MEMO.clear()


def _memo(spark: SparkSession, sf_dir: str, name: str, build: Callable):
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    if key not in _MEMO:
        _MEMO[key] = build()
    return _MEMO[key]


def corpus_of(spark: SparkSession, sf_dir: str) -> Corpus:
    return _memo(spark, sf_dir, "corpus", lambda: Corpus(spark, sf_dir, CascadeConfig()))


def cascade_model(spark, sf_dir) -> cascade.CascadeModel:
    return _memo(spark, sf_dir, "cascade_model", lambda: cascade.fit_cascade(corpus_of(spark, sf_dir)))


def cascade_eval_df(spark, sf_dir) -> DataFrame:
    """Scored test rows, materialised once: every report and curve reads the same scores."""
    return _memo(spark, sf_dir, "cascade_eval", lambda: cut_lineage(
        cascade.cascade_eval(corpus_of(spark, sf_dir), cascade_model(spark, sf_dir)), "cascade_eval"))


def baseline_counts(spark, sf_dir) -> bayes.NaiveBayesCounts:
    """(gram -> label) training counts: the cascade's sentiment counts with the language summed out."""
    def build():
        cp = corpus_of(spark, sf_dir)
        train = cp.docs.where(F.col("split") == "train")
        return bayes.count_marginal(cascade_model(spark, sf_dir).sent_counts, "language", train, "label")
    return _memo(spark, sf_dir, "baseline_counts", build)


def baseline_model(spark, sf_dir):
    cp = corpus_of(spark, sf_dir)
    return _memo(spark, sf_dir, "baseline_model", lambda: (
        baseline_counts(spark, sf_dir).model(cp.config.alpha), cp.dictionary("label")))


def baseline_eval_df(spark, sf_dir) -> DataFrame:
    def build():
        m, sd = baseline_model(spark, sf_dir)
        test = corpus_of(spark, sf_dir).features.where(F.col("split") == "test")
        s = bayes.score(m, test, id_cols=["doc_id", "label"], out="sent_scores")
        return cut_lineage(s.select(
            "doc_id", "label", sd.decode(bayes.predict_ids("sent_scores")).alias("predicted_label"),
            sd.encode("label").alias("label_id"),
            bayes.predict_ids("sent_scores").alias("predicted_label_id"), "sent_scores"), "baseline_eval")
    return _memo(spark, sf_dir, "baseline_eval", build)


# ---------------------------------------------------------------- sources, corpus

def q_corpus_clean(spark, sf_dir):
    return tables.corpus(spark, sf_dir)


def q_label_dictionary(spark, sf_dir):
    c = tables.corpus(spark, sf_dir)
    one = [Dictionary.fit(c, f).frame.select(F.lit(f).alias("field"), F.col("idx").cast("int").alias("idx"), "value")
           for f in ("label", "language")]
    return one[0].unionByName(one[1])


def q_label_encode(spark, sf_dir):
    docs = corpus_of(spark, sf_dir).docs
    out = Dictionary.fit(docs, "label").encode(docs, "label", "label_id")
    out = Dictionary.fit(docs, "language").encode(out, "language", "language_id")
    return out.select("doc_id", F.col("label_id").cast("int").alias("label_id"),
                      F.col("language_id").cast("int").alias("language_id"))


def q_label_decode(spark, sf_dir):
    ev = cascade_eval_df(spark, sf_dir).select("doc_id", "predicted_label_id", "predicted_language_id")
    docs = corpus_of(spark, sf_dir).docs
    out = Dictionary.fit(docs, "label").decode(ev, "predicted_label_id", "predicted_label")
    return Dictionary.fit(docs, "language").decode(out, "predicted_language_id", "predicted_language")


def q_langid_target(spark, sf_dir):
    return corpus_of(spark, sf_dir).docs.select("doc_id", F.col("language").alias("label"))


def q_prefix_gold(spark, sf_dir):
    c = tables.corpus(spark, sf_dir)
    p = prefixed("language", "text", CascadeConfig().separator)
    return c.select("doc_id", F.md5(p).alias("prefixed_md5"), F.length(p).cast("long").alias("prefixed_chars"))


def q_prefix_predicted(spark, sf_dir):
    ev = cascade_eval_df(spark, sf_dir).select("doc_id", "predicted_language")
    c = tables.corpus(spark, sf_dir).select("doc_id", "text")
    p = prefixed("predicted_language", "text", CascadeConfig().separator)
    return ev.join(c, "doc_id").select("doc_id", F.md5(p).alias("prefixed_md5"),
                                       F.length(p).cast("long").alias("prefixed_chars"))


def q_tokens_truncated(spark, sf_dir):
    return token_stats(tables.corpus(spark, sf_dir), MAX_TOKENS)


def q_token_sequences(spark, sf_dir):
    """The tokens that a model of 512 inputs is given of (language, separator, text), as a digest."""
    c = tables.corpus(spark, sf_dir)
    prefix = F.concat("language", F.lit(CascadeConfig().separator))
    t = token_sequences(c, MAX_TOKENS, prefix)
    return t.select("doc_id", F.size("tokens").cast("long").alias("n_kept"), "n_tokens", "n_cut",
                    F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


def q_shuffle_seeded(spark, sf_dir):
    return seeded_order(tables.corpus(spark, sf_dir).select("doc_id"), "doc_id", out="position")


# ---------------------------------------------------------------- split, folds

def q_split_stratified(spark, sf_dir):
    return corpus_of(spark, sf_dir).docs.select("doc_id", "label", "split")


def q_split_sizes(spark, sf_dir):
    return split_sizes(corpus_of(spark, sf_dir).docs)


def q_split_by_language(spark, sf_dir):
    d = corpus_of(spark, sf_dir).docs.select("doc_id", "language")
    return assign_split_and_fold(d, "language", fold_out=None).select("doc_id", "language", "split")


def q_kfold_stratified(spark, sf_dir):
    return corpus_of(spark, sf_dir).docs.select("doc_id", "label", "fold")


def q_kfold_sizes(spark, sf_dir):
    d = corpus_of(spark, sf_dir).docs
    return d.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- features, models

def q_gram_counts(spark, sf_dir):
    f = corpus_of(spark, sf_dir).features
    return f.where(F.col("gram").isNotNull()).select("doc_id", "gram", "n")


def _model_long(model: bayes.NaiveBayesModel, dictionary: ClassDictionary) -> DataFrame:
    t = model.table.select(*model.keys, F.posexplode("scores").alias("_i", "score"))
    return t.select(*model.keys, dictionary.decode(F.col("_i")).alias("class"), "score")


def q_langid_model(spark, sf_dir):
    m = cascade_model(spark, sf_dir)
    return _model_long(m.language, m.lang_dict)


def q_conditioned_model(spark, sf_dir):
    m = cascade_model(spark, sf_dir)
    return _model_long(m.sentiment, m.sent_dict)


def q_baseline_model(spark, sf_dir):
    m, sd = baseline_model(spark, sf_dir)
    return _model_long(m, sd)


def q_class_scores(spark, sf_dir):
    ev = cascade_eval_df(spark, sf_dir)
    d = cascade_model(spark, sf_dir).lang_dict
    return ev.select("doc_id", F.posexplode("lang_scores").alias("_i", "score")).select(
        "doc_id", d.decode(F.col("_i")).alias("class"), "score")


def q_argmax_label(spark, sf_dir):
    return cascade_eval_df(spark, sf_dir).select("doc_id", "predicted_language_id", "predicted_label_id")


def q_cascade_eval(spark, sf_dir):
    return cascade_eval_df(spark, sf_dir).select("doc_id", "language", "predicted_language", "label",
                                                 "predicted_label")


def q_cascade_gold_vs_pred(spark, sf_dir):
    cp = corpus_of(spark, sf_dir)
    m = cascade_model(spark, sf_dir)
    gold = cascade.cascade_eval(cp, m, gold_language=True).select(
        "doc_id", F.col("predicted_label").alias("predicted_label_gold"))
    pred = cascade.cascade_eval(cp, m).select("doc_id", "label", "predicted_label")
    return pred.join(gold, "doc_id")


def q_predict(spark, sf_dir):
    return cascade.predict_unlabelled(corpus_of(spark, sf_dir), cascade_model(spark, sf_dir)).drop("text")


def q_best_candidate(spark, sf_dir):
    """Smoothing candidates scored in one pass; best by weighted F1, ties to the first."""
    cp = corpus_of(spark, sf_dir)
    sd = cp.dictionary("label")
    model = baseline_counts(spark, sf_dir).candidates(CANDIDATE_ALPHAS)
    test = cp.features.where(F.col("split") == "test")
    s = bayes.score(model, test, id_cols=["doc_id", "label"], out="sent_scores", all_slices=True)
    preds = s.select("candidate", "label", sd.decode(bayes.predict_ids("sent_scores")).alias("predicted_label"))
    per = metrics.weighted_prf(preds, "label", "predicted_label", by=["candidate"])
    # one row per candidate: the window spans the few candidates only
    best = F.max_by("candidate", F.struct(F.col("f1"), -F.col("candidate"))).over(Window.partitionBy())
    alpha = F.element_at(F.array(*[F.lit(a) for a in CANDIDATE_ALPHAS]), F.col("candidate") + 1)
    return per.withColumn("_best", best).select(
        "candidate", alpha.alias("alpha"), "accuracy", "f1", (F.col("candidate") == F.col("_best")).alias("is_best"))


def _choice(spark, sf_dir, by) -> choice.Choice:
    return _memo(spark, sf_dir, f"choice_{by}", lambda: choice.choose_baseline(
        corpus_of(spark, sf_dir), baseline_counts(spark, sf_dir), CANDIDATE_ALPHAS, by))


def q_best_candidate_loss(spark, sf_dir):
    """Smoothing candidates judged by their loss on a held-out fold of the training rows."""
    return _choice(spark, sf_dir, "eval_loss").candidates


def q_predict_best(spark, sf_dir):
    """Test rows under the model chosen by loss, fitted again on all training rows."""
    c = _choice(spark, sf_dir, "eval_loss")
    s = bayes.score(c.model, corpus_of(spark, sf_dir).features.where(F.col("split") == "test"),
                    id_cols=["doc_id", "label"], out="sent_scores")
    return s.select("doc_id", "label", c.classes.decode(bayes.predict_ids("sent_scores")).alias("predicted_label"),
                    F.lit(float(c.alpha)).alias("alpha"))


# ---------------------------------------------------------------- metrics

def q_confusion(spark, sf_dir):
    return metrics.confusion(cascade_eval_df(spark, sf_dir), "label", "predicted_label")


def q_accuracy(spark, sf_dir):
    return metrics.accuracy(baseline_eval_df(spark, sf_dir), "label", "predicted_label")


def q_weighted_prf(spark, sf_dir):
    return metrics.weighted_prf(baseline_eval_df(spark, sf_dir), "label", "predicted_label")


def q_class_report(spark, sf_dir):
    return metrics.class_report(cascade_eval_df(spark, sf_dir), "label", "predicted_label")


def q_class_report_full(spark, sf_dir):
    """Sentiment report of every language over all classes of the dictionary, with or without rows."""
    ev = cascade_eval_df(spark, sf_dir)
    classes = corpus_of(spark, sf_dir).dictionary("label").table(spark)
    return metrics.full_report(ev, classes, "label", "predicted_label", by=["language"])


def q_language_report(spark, sf_dir):
    classes = corpus_of(spark, sf_dir).dictionary("language").table(spark)
    return metrics.full_report(cascade_eval_df(spark, sf_dir), classes, "language", "predicted_language")


def q_baseline_report(spark, sf_dir):
    classes = corpus_of(spark, sf_dir).dictionary("label").table(spark)
    return metrics.full_report(baseline_eval_df(spark, sf_dir), classes, "label", "predicted_label")


def _langid(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Stand-alone language identification: split stratified on the language, fit, score the test part."""
    def build():
        cp = corpus_of(spark, sf_dir)
        assigned = cut_lineage(assign_split_and_fold(cp.docs.select("doc_id", "language"), "language", fold_out=None), "langsplit")
        feats = cp.features.select("doc_id", "language", "gram", "n").join(assigned.select("doc_id", "split"), "doc_id")
        classes = cp.dictionary("language")
        model = bayes.fit(feats.where(F.col("split") == "train"), assigned.where(F.col("split") == "train"),
                          "language", classes.classes)
        s = bayes.score(model, feats.where(F.col("split") == "test"), id_cols=["doc_id", "language"])
        preds = cut_lineage(s.select("doc_id", "language", classes.decode(bayes.predict_ids()).alias("predicted_language")), "langid")
        return preds, metrics.metrics_long(preds, "language", "predicted_language")
    return _memo(spark, sf_dir, "langid", build)


def q_langid_run(spark, sf_dir):
    return _langid(spark, sf_dir)[0]


def q_langid_metrics(spark, sf_dir):
    return _langid(spark, sf_dir)[1]


def q_report_totals(spark, sf_dir):
    return metrics.report_totals(cascade_eval_df(spark, sf_dir), "label", "predicted_label")


def q_metrics_by_key(spark, sf_dir):
    return metrics.weighted_prf(cascade_eval_df(spark, sf_dir), "label", "predicted_label", by=["language"])


def q_eval_loss(spark, sf_dir):
    return metrics.eval_loss(baseline_eval_df(spark, sf_dir), "sent_scores", "label_id")


def q_cascade_summary(spark, sf_dir):
    ev = cascade_eval_df(spark, sf_dir)
    hit_l = F.when(F.col("language") == F.col("predicted_language"), 1).otherwise(0)
    hit_s = F.when(F.col("label") == F.col("predicted_label"), 1).otherwise(0)
    return ev.agg(F.round(F.avg(hit_l), metrics.DIGITS).alias("lang_accuracy"),
                  F.round(F.avg(hit_s), metrics.DIGITS).alias("sent_accuracy"),
                  F.count(F.lit(1)).alias("n_test"))


# ---------------------------------------------------------------- cross-validation

def sentiment_fold_counts(spark, sf_dir) -> bayes.FoldCounts:
    """Fold counts shared by both cross-validations (one pass over the count table)."""
    return _memo(spark, sf_dir, "sentiment_fold_counts",
                 lambda: crossval.sentiment_fold_counts(corpus_of(spark, sf_dir)))


def cv_baseline_df(spark, sf_dir):
    return _memo(spark, sf_dir, "cv_baseline", lambda: cut_lineage(
        crossval.cv_baseline(corpus_of(spark, sf_dir), sentiment_fold_counts(spark, sf_dir)), "cv_baseline"))


def cv_cascade_df(spark, sf_dir):
    return _memo(spark, sf_dir, "cv_cascade", lambda: cut_lineage(
        crossval.cv_cascade(corpus_of(spark, sf_dir), sentiment_fold_counts(spark, sf_dir)), "cv_cascade"))


def q_cv_baseline(spark, sf_dir):
    return cv_baseline_df(spark, sf_dir).select("doc_id", "fold", "label", "predicted_label")


def q_cv_cascade(spark, sf_dir):
    return cv_cascade_df(spark, sf_dir).select("doc_id", "fold", "language", "predicted_language", "label",
                                               "predicted_label")


def q_oof_predictions(spark, sf_dir):
    return cv_baseline_df(spark, sf_dir).select("doc_id", "label_id", "predicted_label_id")


def q_cv_fold_metrics(spark, sf_dir):
    return crossval.fold_metrics(cv_baseline_df(spark, sf_dir))


def q_cv_mean_metrics(spark, sf_dir):
    return crossval.mean_metrics(crossval.fold_metrics(cv_baseline_df(spark, sf_dir)))


def q_cv_pooled_report(spark, sf_dir):
    return metrics.class_report(cv_cascade_df(spark, sf_dir), "label", "predicted_label")


def q_cv_pooled_report_baseline(spark, sf_dir):
    classes = corpus_of(spark, sf_dir).dictionary("label").table(spark)
    return metrics.full_report(cv_baseline_df(spark, sf_dir), classes, "label", "predicted_label")


def q_cv_pooled_report_language(spark, sf_dir):
    classes = corpus_of(spark, sf_dir).dictionary("language").table(spark)
    return metrics.full_report(cv_cascade_df(spark, sf_dir), classes, "language", "predicted_language")


# ---------------------------------------------------------------- curves

def _sent_ovr(spark, sf_dir):
    ev = cascade_eval_df(spark, sf_dir)
    k = cascade_model(spark, sf_dir).sent_dict.size
    return curves.one_vs_rest(ev, "sent_scores", "label_id", k)


def q_one_vs_rest(spark, sf_dir):
    return _sent_ovr(spark, sf_dir)


def _sent_roc(spark, sf_dir) -> DataFrame:
    """Running sums of the sentiment scores, shared by the points and the areas."""
    return _memo(spark, sf_dir, "sent_roc", lambda: curves.roc_table(_sent_ovr(spark, sf_dir)))


def _baseline_roc(spark, sf_dir) -> DataFrame:
    def build():
        ev, (_, sd) = baseline_eval_df(spark, sf_dir), baseline_model(spark, sf_dir)
        return curves.roc_table(curves.one_vs_rest(ev, "sent_scores", "label_id", sd.size))
    return _memo(spark, sf_dir, "baseline_roc", build)


def q_roc_points(spark, sf_dir):
    return curves.roc_points(_sent_roc(spark, sf_dir))


def q_roc_auc(spark, sf_dir):
    return curves.roc_auc(_sent_roc(spark, sf_dir))


def q_roc_points_baseline(spark, sf_dir):
    return curves.roc_points(_baseline_roc(spark, sf_dir))


def q_roc_auc_baseline(spark, sf_dir):
    return curves.roc_auc(_baseline_roc(spark, sf_dir))


def _embedding_ovr(spark, sf_dir):
    e = tables.read_table(spark, sf_dir, "embeddings")
    k = int(e.agg(F.max("label")).first()[0]) + 1   # one number: the class count
    return curves.one_vs_rest(e.withColumn("scores", F.col("embedding").cast("array<double>")),
                              "scores", "label", k, use_margin=False, id_col="vec_id")


def _embedding_roc(spark, sf_dir) -> DataFrame:
    return _memo(spark, sf_dir, "embedding_roc", lambda: curves.roc_table(_embedding_ovr(spark, sf_dir)))


def q_roc_points_embeddings(spark, sf_dir):
    return curves.roc_points(_embedding_roc(spark, sf_dir))


def q_roc_auc_embeddings(spark, sf_dir):
    return curves.roc_auc(_embedding_roc(spark, sf_dir))


# ---------------------------------------------------------------- sources and sinks

def q_tsv_roundtrip(spark, sf_dir):
    """documents -> tab-separated part files per language -> read back (whole texts)."""
    path = models.new_folder(spark, "tsv")
    docs = tables.read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("lang").alias("language"))
    tsv.write_tsv(docs, path, partition_by="language")
    ok, _ = tsv.split_rejects(tsv.read_tsv(spark, path, columns=("doc_id", "text"), partition="language"))
    return ok.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "language")


def _language_files(spark, sf_dir) -> tuple[str, list[str]]:
    """Corpus written in one pass as one folder of part files per language (``language=<code>``)."""
    def build():
        path = models.new_folder(spark, "langfiles")
        c = tables.corpus(spark, sf_dir)
        tsv.write_tsv(c.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "label", "language"),
                      path, partition_by="language")
        return path, list(ClassDictionary.fit(c, "language").classes)
    return _memo(spark, sf_dir, "language_files", build)


def q_union_languages(spark, sf_dir):
    """One file set per language, language appended as a constant, positional union, nulls dropped."""
    path, langs = _language_files(spark, sf_dir)
    frames = []
    files, _ = tsv.split_rejects(tsv.read_tsv(spark, path, columns=("doc_id", "text", "label"), partition="language"))
    for lang in langs:   # one read of the language's folder per class: the class list is small and bounded
        one = files.where(F.col("language") == F.lit(lang)).select("doc_id", "text", "label")
        frames.append(one.withColumn("language", F.lit(lang)))
    u = tsv.positional_union(frames, ("doc_id", "text", "label", "language"))
    u = tables.clean_corpus(u)
    return u.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label", "language")


def q_many_file_scan(spark, sf_dir):
    """All language files in one scan; the language comes from each file's folder name."""
    path, _ = _language_files(spark, sf_dir)
    u, _ = tsv.read_language_files(spark, path, columns=("doc_id", "text", "label"), partition="language")
    u = tables.clean_corpus(u)
    return u.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label", "language")


def _uneven_files(spark, sf_dir) -> str:
    """documents as records of (doc_id, text, lang), some with other widths: by id modulo 5, one empty field more,
    three fields more, or the language left out."""
    path = models.new_folder(spark, "uneven")
    d = tables.read_table(spark, sf_dir, "documents").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    kind = F.col("doc_id") % 5
    tail = (F.when(kind == 1, F.concat(F.lit("\t"), "lang", F.lit("\t")))
            .when(kind == 2, F.concat(F.lit("\t"), "lang", F.lit('\t\t"a\tb"\tc')))
            .when(kind == 3, F.lit("")).otherwise(F.concat(F.lit("\t"), "lang")))
    d.select(F.concat(F.col("doc_id").cast("string"), F.lit("\t"), quoted, tail).alias("value")).write.text(path)
    return path


def q_tsv_rejects(spark, sf_dir):
    """Rows of the expected width and rejected records, each with its width and a digest of its content."""
    ok, bad = tsv.split_rejects(tsv.read_tsv(spark, _uneven_files(spark, sf_dir), columns=("doc_id", "text", "lang"), header=False))
    kept = ok.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(3).alias("n_fields"), F.lit(True).alias("kept"),
                     F.md5(F.concat_ws("\t", "text", "lang")).alias("content_md5"))
    lost = bad.select(F.substring_index("record", "\t", 1).cast("long").alias("doc_id"), "n_fields", F.lit(False).alias("kept"),
                      F.md5("record").alias("content_md5"))
    return kept.union(lost)


def _baseline_results(spark, sf_dir) -> tuple[str, str]:
    def build():
        ev = baseline_eval_df(spark, sf_dir)
        preds = ev.select("doc_id", "label_id", "predicted_label_id", "label", "predicted_label")
        wide = metrics.weighted_prf(ev, "label", "predicted_label")
        return models.write_results(preds, models.metrics_rows(wide), models.new_folder(spark, "results"))
    return _memo(spark, sf_dir, "baseline_results", build)


def q_results_tables(spark, sf_dir):
    return spark.read.parquet(_baseline_results(spark, sf_dir)[0])


def q_results_metrics(spark, sf_dir):
    return spark.read.parquet(_baseline_results(spark, sf_dir)[1])


def _cascade_results(spark, sf_dir) -> tuple[str, str]:
    def build():
        ev = cascade_eval_df(spark, sf_dir)
        preds = ev.select("doc_id", "language_id", "predicted_language_id", "label_id", "predicted_label_id",
                          "language", "predicted_language", "label", "predicted_label")
        wide = q_cascade_summary(spark, sf_dir)
        return models.write_results(preds, models.metrics_rows(wide, ("lang_accuracy", "sent_accuracy")),
                                    models.new_folder(spark, "results"))
    return _memo(spark, sf_dir, "cascade_results", build)


def q_cascade_results(spark, sf_dir):
    return spark.read.parquet(_cascade_results(spark, sf_dir)[0])


def q_cascade_results_metrics(spark, sf_dir):
    return spark.read.parquet(_cascade_results(spark, sf_dir)[1])


def q_baseline_reload(spark, sf_dir):
    """Save the fitted one-stage model, load it back (guarded), score the test rows."""
    path = models.save_baseline(baseline_model(spark, sf_dir)[0], models.new_folder(spark, "models"))
    m, sd = models.load_baseline(spark, path)
    s = bayes.score(m, corpus_of(spark, sf_dir).features.where(F.col("split") == "test"), out="sent_scores")
    return s.select("doc_id", sd.decode(bayes.predict_ids("sent_scores")).alias("predicted_label"))


def q_model_reload_predict(spark, sf_dir):
    """Save the fitted cascade, load it back (guarded), predict the unlabelled documents."""
    path = models.save_cascade(cascade_model(spark, sf_dir), models.new_folder(spark, "models"))
    loaded = models.load_cascade(spark, path)
    return cascade.predict(loaded, tables.unlabelled_documents(spark, sf_dir)).drop("text")


def q_predict_conversations(spark, sf_dir):
    """Cascade on every conversation turn, keyed by (conv_id, turn)."""
    conv = tables.read_table(spark, sf_dir, "conversations").select(
        F.struct("conv_id", "turn").alias("key"), "text")
    p = cascade.predict(cascade_model(spark, sf_dir), conv, id_col="key")
    return p.select("key.conv_id", "key.turn", "predicted_language", "predicted_sentiment")


def q_predict_stream(spark, sf_dir):
    """The unlabelled documents as a file stream, scored batch by batch with the fitted cascade."""
    base = models.new_folder(spark, "stream")
    docs = tables.unlabelled_documents(spark, sf_dir)
    docs.write.parquet(f"{base}/in")
    q = start_prediction_stream(spark, cascade_model(spark, sf_dir), f"{base}/in", f"{base}/out",
                                f"{base}/checkpoint", schema=docs.schema)
    q.awaitTermination()
    return read_predictions(spark, f"{base}/out", docs.schema).select("doc_id", "predicted_language", "predicted_sentiment")


# ---------------------------------------------------------------- iterative trainer, user model

def _lr_vectors(spark, sf_dir) -> DataFrame:
    cp = corpus_of(spark, sf_dir)
    return _memo(spark, sf_dir, "lr_vectors", lambda: trainer.vectors(cp.features, ("doc_id", "label", "split")))


def _lr_model(spark, sf_dir) -> trainer.TrainedModel:
    return _memo(spark, sf_dir, "lr_model", lambda: trainer.fit(
        _lr_vectors(spark, sf_dir).where(F.col("split") == "train"), corpus_of(spark, sf_dir).dictionary("label")))


def q_lr_train_predict(spark, sf_dir):
    test = _lr_vectors(spark, sf_dir).where(F.col("split") == "test")
    return _lr_model(spark, sf_dir).predict(test).select("doc_id", "label", "predicted_label")


def q_lr_slots(spark, sf_dir):
    """Every document's sparse vector: filled slots, summed counts, and a digest of slot:count in slot order."""
    e = trainer.slot_counts(corpus_of(spark, sf_dir).features)
    pairs = F.transform("entries", lambda x: F.concat(x["slot"].cast("string"), F.lit(":"), x["n"].cast("string")))
    return e.select("doc_id", F.size("entries").cast("long").alias("n_slots"),
                    F.aggregate("entries", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_grams"),
                    F.md5(F.array_join(pairs, ",")).alias("slots_md5"))


def q_lr_losses(spark, sf_dir):
    """Loss before the first pass (class shares with a row added to each), and whether every pass lowered it."""
    h = trainer.losses_frame(spark, _lr_model(spark, sf_dir))
    each = h.select("pass", "loss", F.lag("loss").over(Window.orderBy("pass")).alias("before"))    # a row per pass
    return each.agg(F.round(F.max(F.when(F.col("pass") == 0, F.col("loss"))), 6).alias("first_loss"),
                    F.bool_and(F.coalesce(F.col("loss") < F.col("before"), F.lit(True))).alias("falling"))


def q_user_model_scores(spark, sf_dir):
    """A user model (nearest centroid, fitted by Spark) run on Arrow batches."""
    e = tables.read_table(spark, sf_dir, "embeddings").withColumn("x", F.col("embedding").cast("array<double>"))
    labels, matrix = trainer.class_centroids(e, "x", "label")
    s = trainer.batch_scores(e, "x", trainer.nearest_centroid_fn(matrix), matrix.shape[1])
    idx = F.array_position(F.col("scores"), F.array_max("scores")) - 1
    return s.select("vec_id", "label", F.element_at(F.array(*[F.lit(v) for v in labels]), idx.cast("int") + 1)
                    .alias("predicted_label"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "tsv_roundtrip": q_tsv_roundtrip,
    "union_languages": q_union_languages,
    "many_file_scan": q_many_file_scan,
    "tsv_rejects": q_tsv_rejects,
    "results_tables": q_results_tables,
    "results_metrics": q_results_metrics,
    "cascade_results": q_cascade_results,
    "cascade_results_metrics": q_cascade_results_metrics,
    "baseline_reload": q_baseline_reload,
    "model_reload_predict": q_model_reload_predict,
    "predict_conversations": q_predict_conversations,
    "predict_stream": q_predict_stream,
    "lr_train_predict": q_lr_train_predict,
    "lr_slots": q_lr_slots,
    "lr_losses": q_lr_losses,
    "user_model_scores": q_user_model_scores,
    "corpus_clean": q_corpus_clean,
    "label_dictionary": q_label_dictionary,
    "label_encode": q_label_encode,
    "label_decode": q_label_decode,
    "langid_target": q_langid_target,
    "prefix_gold": q_prefix_gold,
    "prefix_predicted": q_prefix_predicted,
    "tokens_truncated": q_tokens_truncated,
    "token_sequences": q_token_sequences,
    "shuffle_seeded": q_shuffle_seeded,
    "split_stratified": q_split_stratified,
    "split_sizes": q_split_sizes,
    "split_by_language": q_split_by_language,
    "kfold_stratified": q_kfold_stratified,
    "kfold_sizes": q_kfold_sizes,
    "gram_counts": q_gram_counts,
    "langid_model": q_langid_model,
    "baseline_model": q_baseline_model,
    "conditioned_model": q_conditioned_model,
    "class_scores": q_class_scores,
    "argmax_label": q_argmax_label,
    "cascade_eval": q_cascade_eval,
    "cascade_gold_vs_pred": q_cascade_gold_vs_pred,
    "predict": q_predict,
    "best_candidate": q_best_candidate,
    "best_candidate_loss": q_best_candidate_loss,
    "predict_best": q_predict_best,
    "confusion": q_confusion,
    "accuracy": q_accuracy,
    "weighted_prf": q_weighted_prf,
    "class_report": q_class_report,
    "class_report_full": q_class_report_full,
    "language_report": q_language_report,
    "baseline_report": q_baseline_report,
    "langid_run": q_langid_run,
    "langid_metrics": q_langid_metrics,
    "report_totals": q_report_totals,
    "metrics_by_key": q_metrics_by_key,
    "eval_loss": q_eval_loss,
    "cascade_summary": q_cascade_summary,
    "cv_baseline": q_cv_baseline,
    "cv_cascade": q_cv_cascade,
    "oof_predictions": q_oof_predictions,
    "cv_fold_metrics": q_cv_fold_metrics,
    "cv_mean_metrics": q_cv_mean_metrics,
    "cv_pooled_report": q_cv_pooled_report,
    "cv_pooled_report_baseline": q_cv_pooled_report_baseline,
    "cv_pooled_report_language": q_cv_pooled_report_language,
    "one_vs_rest": q_one_vs_rest,
    "roc_points": q_roc_points,
    "roc_auc": q_roc_auc,
    "roc_points_baseline": q_roc_points_baseline,
    "roc_auc_baseline": q_roc_auc_baseline,
    "roc_points_embeddings": q_roc_points_embeddings,
    "roc_auc_embeddings": q_roc_auc_embeddings,
}
