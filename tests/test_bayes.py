from pyspark.sql import functions as F

from babelcask.operators import bayes
from babelcask.operators.features import gram_counts
from babelcask.operators.split import assign_split_and_fold

TEXTS = [
    (1, "the cat sat on the mat", "en", "pos"), (2, "le chat est sur le tapis", "fr", "neg"),
    (3, "the dog ran far", "en", "neg"), (4, "le chien court loin", "fr", "pos"),
    (5, "a cat and a dog", "en", "pos"), (6, "un chat et un chien", "fr", "neg"),
    (7, "the mat is red", "en", "pos"), (8, "le tapis est rouge", "fr", "pos"),
    (9, "cats sit", "en", "neg"), (10, "chats assis", "fr", "neg"),
]


def _feats(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, language string, label string")
    docs = assign_split_and_fold(df.select("doc_id", "language", "label"), "label")
    f = gram_counts(df, carry=("label", "language")).join(docs.select("doc_id", "split", "fold"), "doc_id")
    return f, docs


def test_gram_counts_word_bounded(spark):
    df = spark.createDataFrame([(1, "Ab ab\tc")], "doc_id long, text string")
    got = {(r["gram"], r["n"]) for r in gram_counts(df).collect()}
    assert got == {("<ab", 2), ("ab>", 2), ("<c>", 1)}


def test_empty_text_keeps_a_row(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "  ")], "doc_id long, text string")
    g = gram_counts(df).collect()
    assert sorted(r["doc_id"] for r in g if r["gram"] is None) == [1, 2, 3]
    assert all(r["n"] == 0 for r in g)


def _slices(model):
    """{(slice, key...): scores}, without the keys that are not in a slice's vocabulary."""
    out = {}
    for r in model.table.collect():
        for f in range(model.slices):
            part = tuple(r["scores"][f * model.k:(f + 1) * model.k])
            if any(part):
                out[(f, *(r[c] for c in model.keys))] = part
    return out


def test_folds_by_subtraction_equal_separate_fits(spark):
    f, docs = _feats(spark)
    classes = ("neg", "pos")
    folded = bayes.fit_folds(f, docs, "label", classes, 5)
    got = _slices(folded)
    for k in range(5):
        direct = bayes.fit(f.where(F.col("fold") != k), docs.where(F.col("fold") != k), "label", classes)
        assert {g: s for (fk, g), s in got.items() if fk == k} == {g: s for (_, g), s in _slices(direct).items()}
        assert folded.priors[k] == direct.priors[0] and folded.vocab[k] == direct.vocab[0]


def test_unknown_text_gets_prior(spark):
    f, docs = _feats(spark)
    m = bayes.fit(f, docs, "label", ("neg", "pos"))
    new = gram_counts(spark.createDataFrame([(99, "zzqx"), (98, None)], "doc_id long, text string"))
    s = {r["doc_id"]: list(r["scores"]) for r in bayes.score(m, new).collect()}
    assert s[99] == list(m.priors[0]) and s[98] == list(m.priors[0])


def test_candidates_in_one_pass_equal_separate_models(spark):
    f, docs = _feats(spark)
    counts = bayes.count(f, docs, "label", ("neg", "pos"))
    many = bayes.score(counts.candidates((1, 3)), f, all_slices=True)
    multi = {(r["doc_id"], r["candidate"]): list(r["scores"]) for r in many.collect()}
    for j, a in enumerate((1, 3)):
        single = {r["doc_id"]: list(r["scores"]) for r in bayes.score(counts.model(a), f).collect()}
        assert {d: s for (d, c), s in multi.items() if c == j} == single


def test_long_arrays_equal_wide_ones(spark, monkeypatch):
    """Above WIDE_SLOTS the sums go over (position, value) rows; every fitted array and score is the same."""
    f, docs = _feats(spark)
    new = gram_counts(spark.createDataFrame([(98, None), (99, "zzqx"), (97, "the chat")], "doc_id long, text string"))

    def everything():
        sc = bayes.fold_counts(f, "label", ("neg", "pos"), 5, keys=("language", "gram"))
        folds = [bayes.fold_model(fc, docs, c) for fc, c in (
            (sc, "label"), (bayes.fold_counts_by_key(sc, "language", ("en", "fr")), "language"),
            (bayes.fold_counts_marginal(sc, "language"), "label"))]
        counts = bayes.count(f, docs, "label", ("neg", "none", "pos"))
        scored = [bayes.score(counts.model(2), new), bayes.score(counts.candidates((1, 2, 3)), new, all_slices=True),
                  bayes.score(folds[2], f, id_cols=["doc_id", "fold"])]
        return ([_slices(m) for m in (*folds, counts.model(2))], [(m.vocab, m.priors, m.rows) for m in folds],
                [sorted((r["doc_id"], r.asDict().get("candidate"), tuple(r["scores"])) for r in s.collect()) for s in scored])
    wide = everything()
    monkeypatch.setattr(bayes, "WIDE_SLOTS", 0)
    assert everything() == wide


def test_many_classes(spark):
    """300 classes: arrays, not plan columns; the class of each document's own word wins."""
    rows = [(i, f"wort{i:03d}", f"k{i:03d}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    m = bayes.fit(gram_counts(df, carry=("label",)), df, "label", [r[2] for r in rows])
    got = bayes.score(m, gram_counts(df)).select("doc_id", bayes.predict_ids("scores").alias("p")).collect()
    assert all(r["p"] == r["doc_id"] for r in got) and len(got) == 300


def test_scores_independent_of_partitioning(spark):
    f, docs = _feats(spark)
    m = bayes.fit(f, docs, "label", ("neg", "pos"))
    a = {tuple(r[:1]) + (tuple(r["scores"]),) for r in bayes.score(m, f).collect()}
    b = {tuple(r[:1]) + (tuple(r["scores"]),) for r in bayes.score(m, f.repartition(5)).collect()}
    assert a == b


def test_shuffled_salted_join_equals_broadcast(spark):
    """Above the broadcast limit the join shuffles with hot keys salted; scores do not change."""
    # ("en", "<th") and ("en", "th>") each hold about a third of the (document, gram) rows
    rows = TEXTS + [(100 + i, "th", "en", "pos" if i % 2 else "neg") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, language string, label string")
    feats = gram_counts(df, carry=("label", "language"))
    m = bayes.fit(feats, df.select("doc_id", "label"), "label", ["neg", "pos"], keys=("language", "gram"))
    assert bayes.hot_keys(feats, [F.col("language"), F.col("gram")], 4).count() == 2
    a = bayes.score(m, feats, id_cols=["doc_id"])
    b = bayes.score(m, feats, id_cols=["doc_id"], broadcast_limit=0)
    assert sorted(tuple(r) for r in a.collect()) == sorted(tuple(r) for r in b.collect())


def test_fold_counts_marginal_equal_direct_fold_fit(spark):
    f, docs = _feats(spark)
    classes = ["neg", "pos"]
    direct = bayes.fit_folds(f, docs, "label", classes, 5)
    sc = bayes.fold_counts(f, "label", classes, 5, keys=("language", "gram"))
    summed = bayes.fold_model(bayes.fold_counts_marginal(sc, "language"), docs, "label")
    assert direct.vocab == summed.vocab and direct.priors == summed.priors
    assert _slices(direct) == _slices(summed)


def test_class_without_training_rows_is_never_predicted(spark):
    """A class of the dictionary whose rows all fall in the test part."""
    from babelcask.operators import bayes
    feats = spark.createDataFrame([(1, "abc", "x", 2), (2, "bcd", "y", 1)], "doc_id long, gram string, label string, n long")
    docs = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, label string")
    model = bayes.fit(feats, docs, "label", ("x", "y", "z"))
    assert model.priors[0][2] == bayes.NO_ROWS_PRIOR
    out = bayes.score(model, feats.select("doc_id", "gram", "n"), out="s").select("doc_id", bayes.predict_ids("s").alias("p"))
    assert sorted((r["doc_id"], r["p"]) for r in out.collect()) == [(1, 0), (2, 1)]
