"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's subwords are the byte runs of 2 to 4 inside its words, border marks
included; each is hashed to one of ``BUCKETS`` rows of an embedding table.
The text is the average of its subwords' embeddings; a linear layer and a
softmax over the languages follow.  Embeddings and layer are trained together
by stochastic gradient descent (numpy, batches of ``BATCH`` texts) on a bounded
sample: ``FIT_ROWS`` distinct texts at most, shared evenly by the languages
(the ``MAX_LANGS`` most frequent ones), taken by the hash of the text, so a
copied text counts once.  A fifth of the sample is kept from the descent: on
it a temperature calibrates the softmax, and the least score is found above
which at most ``MAX_ERROR`` of the answers are wrong.  Texts below it are
answered with ``accepted`` false (the rejection); ``lang_pred`` always holds
the best language.

The sample is gathered in one task as (bucket, count) pairs, and that task
trains; the fitted model has a fixed size (``BUCKETS`` x languages or ``DIM``)
and is handed to the scoring tasks, which read whole texts and average over
all subwords.  The layer is linear, so with no more languages than ``DIM`` the
tasks average the products of embeddings and layer instead, which is the same.

Languages, sources and ids are no inputs of a prediction.

Defined cases: a null text, or one without a letter, is ``und`` with score 0,
not accepted; so is every text if nothing can be learned from; with one learned
language its score is 1; a null id reads as an empty text in the hash; texts
without a language are predicted, not learned from; repeated rows each get a
row; other columns are not looked at.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from babelcask.llm import tokens as T

BITS = 15
BUCKETS = 1 << BITS
DIM = 16
GRAMS = (2, 3, 4)
FIT_ROWS = 4_000
MAX_LANGS = 1_000
EPOCHS, BATCH, RATE = 8, 32, 0.5
MAX_ERROR = 0.01
PIECE = 500_000
UNKNOWN = "und"

_rng = np.random.Generator(np.random.PCG64(11))
_WEIGHT = _rng.integers(1, 2**31, 8, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
# letters of one byte in lower case, bytes of longer characters as they are; all else is the border mark 0
_LETTER = np.zeros(256, np.uint8)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def subwords(data: np.ndarray, texts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of the subwords of texts given as bytes and offsets, one gram size at a time."""
    # a border mark before each text and at the end; runs of marks count as one
    begins = texts + np.arange(len(texts))
    body = np.append(np.insert(_LETTER[data], texts, 0), np.uint8(0))
    owner = np.repeat(np.arange(len(texts)), np.diff(np.append(begins, len(body))))
    keep = body != 0
    keep[1:] |= body[:-1] != 0
    keep[begins] = True
    body, owner = body[keep], owner[keep]
    mark = body == 0
    for n in GRAMS:
        size = len(body) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n, np.uint32) * _WEIGHT[7]
        inside = np.ones(size, bool)
        for k in range(n):
            h += body[k: k + size] * _WEIGHT[k]
            if 0 < k < n - 1:
                inside &= ~mark[k: k + size]
        if n == 2:
            inside &= ~(mark[:size] & mark[1:])
        h = h[inside]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        yield owner[:size][inside], (h >> np.uint32(32 - BITS)).astype(np.int32)


def _pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, offsets) over runs of texts of about ``PIECE`` bytes; a longer text comes in several
    pieces cut at border marks (none within a piece's length: cut there)."""
    data, texts = T.raw_bytes(column)
    i, n = 0, len(texts) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(texts, texts[i] + PIECE, "right")) - 1))
        a, b = int(texts[i]), int(texts[j])
        while b - a > PIECE and j == i + 1:
            marks = np.flatnonzero(_LETTER[data[a: a + PIECE]] == 0)
            cut = a + (int(marks[-1]) + 1 if len(marks) else PIECE)
            yield i, data[a:cut], np.array([0, cut - a])
            a = cut
        yield i, data[a:b], np.maximum(texts[i: j + 1], a) - a
        i = j


def _sampler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, key, ids, counts): the distinct buckets of each text with their numbers."""
    for batch in batches:
        for r in range(batch.num_rows):
            tally = np.zeros(BUCKETS, np.int64)
            for _, data, texts in _pieces(batch.column("text").slice(r, 1)):
                for _, ids in subwords(data, texts[:-1]):
                    tally += np.bincount(ids, minlength=BUCKETS)
            ids = np.flatnonzero(tally)
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang").slice(r, 1), batch.column("key").slice(r, 1),
                 pa.array([ids.astype(np.int32)]), pa.array([tally[ids].astype(np.float32)])],
                names=["lang", "key", "ids", "counts"])


def _averages(table: np.ndarray, ids: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    sizes = np.array([len(x) for x in ids])
    return np.add.reduceat(table[np.concatenate(ids)] * np.concatenate(weights)[:, None], np.cumsum(sizes) - sizes)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(ids: list[np.ndarray], weights: list[np.ndarray], y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, layer and intercept by stochastic gradient descent; ``weights`` sum to 1 per text."""
    rng = np.random.Generator(np.random.PCG64(7))
    table = rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32)
    layer, base = rng.normal(0, 0.3, (DIM, k)).astype(np.float32), np.zeros(k, np.float32)
    steps = max(1, EPOCHS * -(-len(ids) // BATCH))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(ids))
        for i in range(0, len(ids), BATCH):
            rate = RATE * (1 - step / steps)
            step += 1
            at = order[i: i + BATCH]
            some, share = [ids[t] for t in at], [weights[t] for t in at]
            hidden = _averages(table, some, share)
            error = _softmax(hidden @ layer + base)
            error[np.arange(len(at)), y[at]] -= 1
            back = error @ layer.T
            layer -= rate * hidden.T @ error / len(at) * 4
            base -= rate * error.mean(0)
            # a bucket's part of an average is small: the step is per text, not per batch
            np.add.at(table, np.concatenate(some), -rate * 8 * np.concatenate(share)[:, None]
                      * np.repeat(back, [len(x) for x in some], axis=0))
    return table, layer, base


def calibrate(logits: np.ndarray, y: np.ndarray, max_error: float = MAX_ERROR) -> tuple[float, float]:
    """(temperature of least log loss, least score whose answers at or above it are wrong at most ``max_error``)."""
    if not len(y):
        return 1.0, 0.0
    grid = np.geomspace(0.05, 20, 121)
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    heat = float(grid[int(np.argmin(loss))])
    p = _softmax(logits / heat)
    order = np.argsort(-p.max(1), kind="stable")
    top = p.max(1)[order]
    wrong = np.cumsum(p.argmax(1)[order] != y[order]) / np.arange(1, len(y) + 1)
    # a score's ties are accepted or rejected together
    last = np.append(top[1:] < top[:-1], True)
    fine = np.flatnonzero(last & (wrong <= max_error))
    return heat, float(top[fine[-1]]) if len(fine) else 1.0


def _trainer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted(((r["key"], r["lang"], np.array(r["ids"], np.int32), np.array(r["counts"], np.float32))
                   for batch in batches for r in batch.to_pylist()), key=lambda r: r[:2])
    rows = [r for r in rows if len(r[2])]
    if rows:
        langs = sorted({r[1] for r in rows})
        y = np.array([langs.index(r[1]) for r in rows])
        ids, weights = [r[2] for r in rows], [r[3] / r[3].sum() for r in rows]
        # every fifth text of a language calibrates
        place = np.empty(len(rows), np.int64)
        for c in range(len(langs)):
            mine = np.flatnonzero(y == c)
            place[mine] = np.arange(len(mine))
        held = place % 5 == 4
        fit = np.flatnonzero(~held)
        table, layer, base = train([ids[i] for i in fit], [weights[i] for i in fit], y[fit], len(langs))
        kept = np.flatnonzero(held)
        logits = np.zeros((0, len(langs)))
        if len(kept):
            logits = _averages(table, [ids[i] for i in kept], [weights[i] for i in kept]) @ layer + base
        heat, least = calibrate(logits.astype(np.float64), y[kept])
        if len(langs) <= DIM:
            table, layer = table @ layer, np.eye(len(langs), dtype=np.float32)
        model = pickle.dumps((langs, table, layer, base, heat, least))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])


def _predictor(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table, layer, base, heat, least = pickle.loads(model.value)
        names = pa.array(langs)
        for batch in batches:
            total = np.zeros((batch.num_rows, table.shape[1]))
            n = np.zeros(batch.num_rows)
            for first, data, texts in _pieces(batch.column("text")):
                for owner, ids in subwords(data, texts[:-1]):
                    found = np.bincount(owner, minlength=len(texts) - 1)
                    some = np.flatnonzero(found)
                    sums = np.add.reduceat(table[ids], (np.cumsum(found) - found)[some], axis=0, dtype=np.float64) if len(some) else 0
                    total[first + some] += sums
                    n[first: first + len(found)] += found
            p = _softmax(((total / np.maximum(n, 1)[:, None]) @ layer + base) / heat)
            best, score = p.argmax(1), p.max(1)
            spoken = batch.column("spoken").to_numpy(zero_copy_only=False) & (n > 0)
            lang = pa.compute.if_else(pa.array(spoken), names.take(pa.array(best)), UNKNOWN)
            score = np.where(spoken, score, 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), lang, pa.array(score), pa.array(spoken & (score >= least))],
                names=["doc_id", "held_out", "lang_pred", "score", "accepted"])
    return run


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean"


def fit_sample(docs: DataFrame, fit_rows: int = FIT_ROWS, max_langs: int = MAX_LANGS) -> DataFrame:
    """(lang, key, text): at most ``fit_rows`` distinct texts (20 a language at least), the smallest hashes of each language."""
    keyed = docs.withColumn("key", F.xxhash64("text"))
    counts = (keyed.groupBy("lang").agg(F.approx_count_distinct("key").alias("n"), F.count(F.lit(1)).alias("rows"))
              .orderBy(F.desc("rows"), "lang").limit(max_langs).collect())
    share = max(20, fit_rows // max(1, len(counts)))
    # a language's texts below its bound are two to three times its share, so what is sorted stays small
    half = 2**63
    plan = docs.sparkSession.createDataFrame(
        [(r["lang"], int(min(half - 1, -half + 2 * half * min(1.0, 2.5 * share / max(1, r["n"]))))) for r in counts],
        "lang string, most long")
    near = (keyed.join(F.broadcast(plan), "lang").filter(F.col("key") <= F.col("most"))
            .groupBy("lang", "key").agg(F.min("text").alias("text")))
    order = Window.partitionBy("lang").orderBy("key")
    return near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= share).drop("place")


def predict(docs: DataFrame, fit_rows: int = FIT_ROWS, max_langs: int = MAX_LANGS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) per row of ``docs(doc_id, text, lang)``."""
    spark = docs.sparkSession
    owner = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang",
                       (F.crc32(owner) % 3 == 1).alias("held_out"),
                       F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("spoken"))
    known = rows.filter("NOT held_out AND spoken AND lang IS NOT NULL").select("text", F.col("lang").cast("string").alias("lang"))
    sample = fit_sample(known, fit_rows, max_langs).mapInArrow(_sampler, "lang string, key long, ids array<int>, counts array<float>")
    # the bounded sample trains in one task; one row, the model, comes back
    fitted = sample.repartition(1).mapInArrow(_trainer, "model binary").collect()
    texts = rows.select("doc_id", "text", "held_out", "spoken")
    if not fitted:
        return texts.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                            F.lit(False).alias("accepted"))
    return texts.mapInArrow(_predictor(spark.sparkContext.broadcast(bytes(fitted[0]["model"]))), PREDICTED)
