"""Toxicity by class-conditional Kneser-Ney models.

The labelled training rows count two classes, toxic and ordinary, in one
``char_kn.fit_shared`` model: each class discounts its own top-level counts
and backs off to the counts of both together, so a rare expression that
neither class has seen often enough scores alike under both.  Grams cross word
borders, so expressions of several words have counts of their own.  A word's
evidence is the difference of its log-likelihoods under the two classes.

A text has two length-normalised features: the mean evidence per word of the
whole text, and the largest mean over ``WINDOW`` consecutive words (shorter
texts: over the text), so that one toxic sentence in a long text shows.  A
logistic curve over both gives the score.  Of the training rows, those whose
crc32(doc_id) mod 4 is 0 or 1 count the model and those of 3 fit the curve
(``FIT_ROWS`` of them at most, the smallest by md5 of the id; the documented
bound of the classifier's sample); remainder 2 is held out from both.

Labels, language, source and id are no inputs of a score.

Defined cases: a null text is empty; an empty text has evidence 0; labels
without a document are not used; a document with several equal labels counts
once, with contradicting ones as toxic; without a training row of either class every score is the
share of toxic rows among the labels, 0 if there are none; repeated documents
each get a row; null ids are never training rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from babelcask.llm import char_kn as K
from babelcask.llm import tokens as T
from babelcask.llm.bitfilter import make_filter, passing
from babelcask.llm.work import Staging

WINDOW = 16
THRESHOLD = 0.3
FIT_ROWS = 50_000
TOXIC, ORDINARY = 1, 0


def bucket(doc_id, parts: int):
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, first, last, w in K.rows_of(batches, lower=True):
        label = batch.column("toxic").slice(first, last - first).to_numpy(zero_copy_only=False).astype(np.int64)
        cls, g, n = K.count_grams(w, label[w.owner()])
        yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(g.astype(np.int64)), pa.array(n)], names=["cls", "g", "c"])


def _labelled(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = passing(wanted.value, batch.column("key").to_numpy().view(np.uint64))
            yield batch.select(["doc_id", "text"]).take(pa.array(at))
    return run


def evidence(arrays: K.HashArrays, window: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio, toxic over ordinary, of each predicted byte."""
    pooled = arrays.log_prob(window, length, K.SHARED)
    gram = K.pack(window, length)
    context = K.pack(window >> np.uint64(8), length - 1)
    side = []
    for cls in (TOXIC, ORDINARY):
        share = np.nan_to_num(np.exp(arrays.find(gram, cls, 0).astype(np.float64)))
        left = arrays.find(context, cls, 1).astype(np.float64)
        left = np.where(np.isnan(left), 1.0, np.exp(left))
        side.append(np.log(share + left * np.exp(pooled)))
    return side[0] - side[1]


def features(w: T.Words, of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, largest window mean) of the words' evidence per text."""
    total = np.concatenate([[0.0], np.cumsum(of_word)])
    a, b = w.rows[:-1], w.rows[1:]
    mean = (total[b] - total[a]) / np.maximum(b - a, 1)
    peak = mean.copy()
    if len(of_word) >= WINDOW:
        sums = (total[WINDOW:] - total[:-WINDOW]) / WINDOW
        long = np.flatnonzero(b - a >= WINDOW)
        if len(long):
            edges = np.column_stack([a[long], b[long] - WINDOW + 1]).ravel()
            padded = np.append(sums, -np.inf)
            peak[long] = np.maximum.reduceat(padded, np.minimum(edges, len(padded) - 1))[::2]
    return mean, peak


FEATURES = "doc_id long, mean_evidence double, peak_evidence double"


def _featurer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = K.HashArrays(model.value)
        for batch, first, last, w in K.rows_of(batches, lower=True):
            if len(w.starts):
                p = K.pieces(w)
                one, gram = K.distinct_grams(p.window, p.length)
                mean, peak = features(w, p.of_words(evidence(arrays, p.window[one], p.length[one])[gram]))
            else:
                mean = peak = np.zeros(last - first)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, last - first), pa.array(mean), pa.array(peak)],
                names=["doc_id", "mean_evidence", "peak_evidence"])
    return run


def _joined_features(texts: DataFrame, model: DataFrame) -> DataFrame:
    """The same features by joins, for a model too large to hand out."""
    numbered = texts.withColumn("row", F.monotonically_increasing_id())
    words = (numbered.select("row", "text")
             .mapInArrow(K.speller(["row"], lower=True), "row long, at long, b binary, skip int"))
    spelled = (K.predictions_of(words.select("b", "skip").distinct())
               .withColumn("n", F.least(F.lit(K.ORDER), F.col("i"))))
    number = lambda part: F.conv(F.hex(part), 16, 10).cast("long")
    size = F.col("n").cast("long")
    grams = spelled.select(
        "b", "skip", F.shiftleft(size, 40).bitwiseOR(number(F.substring("b", F.col("i") - F.col("n") + 1, F.col("n")))).alias("g"),
        F.shiftleft(size - 1, 40).bitwiseOR(number(F.substring("b", F.col("i") - F.col("n") + 1, F.col("n") - 1))).alias("h"))
    # a pooled probability per gram: the gram's bytes scored as one prediction
    distinct = grams.select("g", "h").distinct()
    pooled_rows = model.filter(F.col("cls") == K.SHARED)
    probs = pooled_rows.filter("kind = 0").select(F.col("g"), F.col("value").cast("double").alias("p"))
    full = distinct
    for cls in (TOXIC, ORDINARY):
        mine = model.filter(F.col("cls") == cls)
        full = (full.join(mine.filter("kind = 0").select("g", F.exp(F.col("value").cast("double")).alias(f"s{cls}")), "g", "left")
                .join(mine.filter("kind = 1").select(F.col("g").alias("h"), F.exp(F.col("value").cast("double")).alias(f"b{cls}")), "h", "left"))
    # pooled backoff: longest known suffix, weights of the longer contexts
    steps = full.select("*", F.explode(F.sequence(F.lit(1), F.shiftright("g", 40).cast("int"))).alias("k"))
    low = lambda n: F.expr(f"shiftleft(1L, CAST(8 * ({n}) AS INT)) - 1")
    steps = (steps.withColumn("gk", F.shiftleft(F.col("k").cast("long"), 40).bitwiseOR(F.col("g").bitwiseAND(low("k"))))
             .withColumn("hk", F.shiftleft(F.col("k").cast("long") - 1, 40).bitwiseOR(F.col("h").bitwiseAND(low("k - 1")))))
    bows = pooled_rows.filter("kind = 1").select(F.col("g").alias("hk"), F.col("value").cast("double").alias("bow"))
    steps = (steps.join(probs.withColumnRenamed("g", "gk"), "gk", "left").join(bows, "hk", "left")
             .groupBy("g", "h", "s1", "s0", "b1", "b0")
             .agg(F.max(F.when(F.col("p").isNotNull(), F.struct("k", "p"))).alias("best"),
                  F.collect_list(F.struct("k", F.coalesce("bow", F.lit(0.0)).alias("bow"))).alias("bows")))
    top = F.coalesce(F.col("best.k"), F.lit(0))
    q = F.exp(F.coalesce(F.col("best.p"), F.lit(-float(np.log(256.0)))) + F.aggregate(
        "bows", F.lit(0.0), lambda s, x: s + F.when(x["k"] > top, x["bow"]).otherwise(0.0)))
    side = lambda c: F.ln(F.coalesce(f"s{c}", F.lit(0.0)) + F.coalesce(f"b{c}", F.lit(1.0)) * q)
    of_gram = steps.select("g", (side(TOXIC) - side(ORDINARY)).alias("e"))
    of_piece = grams.join(of_gram, "g").groupBy("b", "skip").agg(F.sum("e").alias("e"))
    per_doc = (words.join(of_piece, ["b", "skip"]).groupBy("row", "at").agg(F.sum("e").alias("e")).groupBy("row")
               .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "e"))), lambda x: x["e"]).alias("es")))
    return (numbered.join(per_doc, "row", "left")
            .select("doc_id", F.coalesce("es", F.array().cast("array<double>")).alias("es"))
            .mapInArrow(_window_features, FEATURES))


def _window_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        es = batch.column("es")
        rows = np.asarray(es.offsets) - es.offsets[0].as_py()
        w = T.Words(np.zeros(0, np.uint8), rows, rows, rows, rows.astype(np.int64))
        mean, peak = features(w, es.flatten().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(mean), pa.array(peak)],
                                         names=["doc_id", "mean_evidence", "peak_evidence"])


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression (ridge 1e-3) on standardised features: (weights with intercept last, centre, scale)."""
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    ridge = np.diag([1e-3] * x.shape[1] + [1e-9])
    weights = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        gradient = z.T @ (p - y) / len(y) + ridge @ weights
        hessian = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge + 1e-9 * np.eye(len(weights))
        step = np.linalg.solve(hessian, gradient)
        weights -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return weights, centre, scale


def score(docs: DataFrame, labels: DataFrame, local_rows: int = K.MAX_LOCAL_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted, features) per row of ``docs(doc_id, text)``; ``labels(doc_id, toxic)``."""
    spark = docs.sparkSession
    stage = Staging(spark, "toxicity")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("long").alias("toxic"))
             .dropna().filter(bucket(F.col("doc_id"), 4) != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .filter(F.col("toxic").isin(0, 1)))
    rest = bucket(F.col("doc_id"), 4)
    # labelled texts move by shuffle at every size; those without a label stay (the filter has no false negatives)
    wanted = spark.sparkContext.broadcast(make_filter(known.select(F.xxhash64("doc_id").alias("key"))))
    chosen = (texts.filter(rest.isin(0, 1)).withColumn("key", F.xxhash64("doc_id"))
              .mapInArrow(_labelled(wanted), "doc_id long, text string"))
    counted = (chosen.join(known.hint("shuffle_hash"), "doc_id").select("text", "toxic")
               .mapInArrow(_counter, "cls long, g long, c long").groupBy("cls", "g").agg(F.sum("c").alias("c")))
    full = stage.write(counted, "grams")
    model = K.fit_shared(full, stage, "kn", 2)
    local = K.local_model(model, local_rows)
    if local is not None:
        featured = texts.mapInArrow(_featurer(spark.sparkContext.broadcast(local)), FEATURES)
    else:
        featured = _joined_features(texts, model)
    featured = stage.write(featured, "features")
    sample = (featured.filter(rest == 3).join(known, "doc_id")
              .select("mean_evidence", "peak_evidence", "toxic", F.md5(F.col("doc_id").cast("string")).alias("m"))
              .orderBy("m", "mean_evidence").limit(FIT_ROWS).drop("m").toPandas())
    y = sample["toxic"].to_numpy(float)
    if 0 < y.sum() < len(y):
        weights, centre, scale = fit_curve(sample[["mean_evidence", "peak_evidence"]].to_numpy(), y)
    else:
        share = known.agg(F.avg("toxic")).first()[0] or 0.0
        odds = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
        weights, centre, scale = np.array([0.0, 0.0, odds]), np.zeros(2), np.ones(2)
    z = F.lit(float(weights[2]))
    for k, name in enumerate(("mean_evidence", "peak_evidence")):
        z = z + float(weights[k]) * (F.col(name) - float(centre[k])) / float(scale[k])
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), z))))
    return featured.select(
        "doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), p.alias("score"),
        (p >= THRESHOLD).cast("int").alias("predicted"), "mean_evidence", "peak_evidence")
