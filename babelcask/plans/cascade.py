"""Two-stage cascade: identify the language, then classify the sentiment with
the identified language as context.  Also the one-stage baseline.

Plan, once per corpus:

1. A narrow per-document table (the corpus without its text) is written
   once; the split and fold columns are computed there and the result is
   bucketed by ``doc_id``.
2. ``documents JOIN labels`` -> null tokens -> drop incomplete rows; text is
   hash-partitioned by ``doc_id`` once and turned into (doc, gram, n) with the
   document's class columns carried along; the count table is bucketed alike.
3. Stage one is fitted on (gram -> language), stage two on
   ((gold language, gram) -> label): the language crosses each gram, so the
   second model is conditioned on it and not merely given a prefix token.
4. Test rows: language scores -> argmax -> name; then (predicted language,
   gram) -> sentiment scores -> argmax.  Language errors reach stage two, as in
   the reference.  Both stages keep the ``doc_id`` partitioning: the fitted
   tables are broadcast after a size check, so scoring adds no shuffle of
   the count table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from babelcask.functions.text import SEPARATOR
from babelcask.operators import bayes
from babelcask.operators.encode import ClassDictionary
from babelcask.operators.features import gram_counts
from babelcask.operators.split import N_FOLDS, SEED, TEST_SIZE, assign_split_and_fold
from babelcask.session import bucketed_table, cut_lineage, text_partitions
from babelcask.sources.tables import corpus, unlabelled_documents


@dataclass
class CascadeConfig:
    separator: str = SEPARATOR
    seed: str = SEED
    test_size: float = TEST_SIZE
    n_folds: int = N_FOLDS
    alpha: int = 1
    stratify_on: str = "label"


@dataclass
class Corpus:
    """Featurised, labelled corpus with split and fold columns."""
    spark: SparkSession
    sf_dir: str
    config: CascadeConfig = field(default_factory=CascadeConfig)
    _feats: DataFrame | None = None
    _docs: DataFrame | None = None
    _narrow: DataFrame | None = None
    _buckets: int | None = None
    _dicts: dict = field(default_factory=dict)

    @property
    def narrow(self) -> DataFrame:
        """(doc_id, label, language, text_bytes): one row per document without its text, written once."""
        if self._narrow is None:
            c = corpus(self.spark, self.sf_dir)
            self._narrow = cut_lineage(c.select("doc_id", "label", "language", F.octet_length("text").alias("text_bytes")),
                                       "narrow")
        return self._narrow

    @property
    def buckets(self) -> int:
        """Buckets of the count table and of ``docs``, by the size of the labelled texts."""
        if self._buckets is None:
            self._buckets = text_partitions(self.narrow, "text_bytes")
        return self._buckets

    @property
    def features(self) -> DataFrame:
        """(doc_id, label, language, split, fold, gram, n): the count table, bucketed by document."""
        if self._feats is None:
            n = self.buckets
            c = corpus(self.spark, self.sf_dir, n_parts=n)
            # the corpus comes hash-partitioned by document: counting adds no exchange
            feats = bucketed_table(gram_counts(c, carry=("label", "language"), partition=False), "doc_id", "feats",
                                   partitioned=True, buckets=n)
            # both tables are bucketed alike: hash the narrow per-document side per
            # bucket and stream the count table through it - no shuffle, no sort
            self._feats = feats.join(self.docs.select("doc_id", "split", "fold").hint("shuffle_hash"), "doc_id")
        return self._feats

    @property
    def docs(self) -> DataFrame:
        """(doc_id, label, language, split, fold): one row per document, built without its grams."""
        if self._docs is None:
            # the split's class plan, ranking and join read the narrow table
            cfg = self.config
            assigned = assign_split_and_fold(self.narrow.select("doc_id", "label", "language"), cfg.stratify_on, test_size=cfg.test_size,
                                             n_folds=cfg.n_folds, seed=cfg.seed)
            self._docs = bucketed_table(assigned.select("doc_id", "label", "language", "split", "fold"), "doc_id", "docs",
                                        buckets=self.buckets)
        return self._docs

    def dictionary(self, column: str) -> ClassDictionary:
        if column not in self._dicts:
            self._dicts[column] = ClassDictionary.fit(self.docs, column)
        return self._dicts[column]


@dataclass
class CascadeModel:
    language: bayes.NaiveBayesModel
    sentiment: bayes.NaiveBayesModel
    lang_dict: ClassDictionary
    sent_dict: ClassDictionary
    _fused: DataFrame | None = field(default=None, repr=False)
    sent_counts: bayes.NaiveBayesCounts | None = field(default=None, repr=False)


def fit_cascade(cp: Corpus, train_filter=None) -> CascadeModel:
    train_filter = train_filter if train_filter is not None else (F.col("split") == "train")
    f = cp.features.where(train_filter)
    d = cp.docs.where(train_filter)
    ld, sd = cp.dictionary("language"), cp.dictionary("label")
    # one pass over the count table for ((language, gram) -> label); the
    # language model's (gram -> language) counts are its row sums
    sent_counts = bayes.count(f, d, "label", sd.classes, keys=("language", "gram"))
    lang_counts = bayes.count_by_key(sent_counts, "language", ld.classes, d)
    return CascadeModel(lang_counts.model(cp.config.alpha), sent_counts.model(cp.config.alpha), ld, sd,
                        sent_counts=sent_counts)


# Largest number of (language, sentiment class) pairs scored in the fused pass.
MAX_FUSED_PAIRS = 256


def fused_table(model: CascadeModel) -> DataFrame:
    """One row per gram: stage-one scores and, language by language, the stage-two scores.

    The stage-two table is keyed by (language, gram); laying the languages
    side by side puts both stages on the same key, so one join of the counts
    feeds both stages.  Fold models keep their folds inside the arrays.
    """
    if model._fused is None:
        lang, sent = model.language, model.sentiment
        zeros = lambda m: F.array_repeat(F.lit(0).cast("bigint"), m.k * m.slices)
        pivot = sent.table.groupBy("gram").agg(*[
            F.first(F.when(F.col("language") == F.lit(l), F.col("scores")), ignorenulls=True).alias(f"_s{i}")
            for i, l in enumerate(model.lang_dict.classes)])
        pivot = pivot.select("gram", F.concat(*[F.coalesce(f"_s{i}", zeros(sent)) for i in range(lang.k)]).alias("_ss"))
        fused = lang.table.withColumnRenamed("scores", "_ls").join(pivot, "gram", "full_outer").select(
            "gram", F.coalesce("_ls", zeros(lang)).alias("_ls"),
            F.coalesce("_ss", F.array_repeat(F.lit(0).cast("bigint"), lang.k * sent.k * sent.slices)).alias("_ss"))
        # fitted once, scored many times: materialise (its size is checked before broadcasting)
        model._fused = cut_lineage(fused, "fused")
    return model._fused


def _fused_bytes(model: CascadeModel) -> int:
    lang, sent = model.language, model.sentiment
    return lang.rows * (8 * (lang.k * lang.slices + lang.k * sent.k * sent.slices) + 72)


def score_cascade(model: CascadeModel, feats: DataFrame, carry=(), gold_language: bool = False,
                  broadcast_limit: int | None = None) -> DataFrame:
    """(doc_id, carry..., lang_scores, predicted_language, sent_scores, predicted_label).

    ``gold_language=True`` crosses stage two with the true ``language`` column
    (the trainer's own evaluation; ``language`` must be carried) instead of the
    predicted one.
    """
    if model.lang_dict.size * model.sent_dict.size > MAX_FUSED_PAIRS:
        return _score_two_pass(model, feats, carry, gold_language, broadcast_limit)
    return _score_fused(model, feats, carry, gold_language, broadcast_limit)


def _score_fused(model: CascadeModel, feats: DataFrame, carry=(), gold_language: bool = False,
                 broadcast_limit: int | None = None) -> DataFrame:
    """Both stages in one join and one aggregation per document (one read of the counts).

    A fitted table above the broadcast limit is joined by one shuffle of the
    counts on the salted gram; the aggregation per document follows.
    """
    lang, sent = model.language, model.sentiment
    kl, ks, folds = lang.k, sent.k, sent.slices
    fold = lang.slice_col
    ids = ["doc_id", *([fold] if fold else []), *carry]
    table = fused_table(model).withColumnRenamed("gram", "_m_gram")
    joined = bayes.join_model(feats, table, [(F.col("gram"), "_m_gram")], "doc_id", _fused_bytes(model), broadcast_limit)
    f = F.col(fold).cast("int") if fold else F.lit(0)
    ls, ss = F.col("_ls"), F.col("_ss")

    def at(i: int):
        if i < kl:
            return ls[f * kl + i]
        l, c = divmod(i - kl, ks)
        return ss[(l * folds + f) * ks + c]

    def whole():
        return F.concat(F.slice(ls, f * kl + 1, kl), *[F.slice(ss, (l * folds + f) * ks + 1, ks) for l in range(kl)])

    sums = bayes.array_sums(joined, ids, kl + kl * ks, "_evidence", at, whole, F.col("n"))
    add = lambda a, b: a + b
    out = sums.withColumn("lang_scores", F.zip_with(lang.prior_column(fold), F.slice("_evidence", 1, kl), add))
    pred = bayes.predict_ids("lang_scores")
    cross = model.lang_dict.encode("language") if gold_language else pred
    out = out.select(*ids, "lang_scores", model.lang_dict.decode(pred).alias("predicted_language"),
                     F.zip_with(sent.prior_column(fold), F.slice("_evidence", kl + 1 + cross * ks, ks), add).alias("sent_scores"))
    return out.withColumn("predicted_label", model.sent_dict.decode(bayes.predict_ids("sent_scores")))


def _score_two_pass(model: CascadeModel, feats: DataFrame, carry=(), gold_language: bool = False,
                    broadcast_limit: int | None = None) -> DataFrame:
    """Stage one, then stage two joined back to the counts by document (very many pairs of classes)."""
    extra = [model.language.slice_col] if model.language.slice_col else []
    ids = ["doc_id", *extra, *carry]
    ls = bayes.score(model.language, feats, id_cols=["doc_id", *extra], out="lang_scores", broadcast_limit=broadcast_limit)
    ls = ls.withColumn("predicted_language", model.lang_dict.decode(bayes.predict_ids("lang_scores")))
    cross_col = "language" if gold_language else "predicted_language"
    # both sides clustered by doc_id: no shuffle of the count table
    stage2 = feats.join(ls.drop(*extra), "doc_id")
    ss = bayes.score(model.sentiment, stage2, key_map={"language": cross_col},
                     id_cols=ids, out="sent_scores", passthrough=["lang_scores", "predicted_language"],
                     broadcast_limit=broadcast_limit)
    return ss.withColumn("predicted_label", model.sent_dict.decode(bayes.predict_ids("sent_scores")))


def cascade_eval(cp: Corpus, model: CascadeModel | None = None, gold_language: bool = False) -> DataFrame:
    """Test rows with true and predicted language and label, and class ids."""
    model = model or fit_cascade(cp)
    test = cp.features.where(F.col("split") == "test")
    s = score_cascade(model, test, carry=("label", "language"), gold_language=gold_language)
    return s.select(
        "doc_id", "language", "predicted_language", "label", "predicted_label",
        model.lang_dict.encode("language").alias("language_id"),
        bayes.predict_ids("lang_scores").alias("predicted_language_id"),
        model.sent_dict.encode("label").alias("label_id"),
        bayes.predict_ids("sent_scores").alias("predicted_label_id"),
        "lang_scores", "sent_scores")


def predict(model: CascadeModel, texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cascade on new texts: (id, text, predicted_language, predicted_sentiment).

    One output row per input row, with equal or null ids too: rows get a
    number of their own, written once with the row.  A null text has null
    predictions; an empty one gets the class priors only.
    """
    rows = cut_lineage(texts.select(F.col(id_col), F.col(text_col).alias("text"), F.octet_length(text_col).alias("_bytes"))
                       .withColumn("_row", F.monotonically_increasing_id()), "predict")
    feats = gram_counts(rows.where(F.col("text").isNotNull()).select(F.col("_row").alias("doc_id"), "text"),
                        n_parts=text_partitions(rows, "_bytes"))
    s = score_cascade(model, feats).select(
        F.col("doc_id").alias("_row"), "predicted_language", F.col("predicted_label").alias("predicted_sentiment"))
    return rows.join(s, "_row", "left").select(id_col, "text", "predicted_language", "predicted_sentiment")


def predict_unlabelled(cp: Corpus, model: CascadeModel | None = None) -> DataFrame:
    model = model or fit_cascade(cp)
    return predict(model, unlabelled_documents(cp.spark, cp.sf_dir))
