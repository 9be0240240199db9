"""Quality rules: n-gram perplexity within bands of its language, and the base rules.

A modified Kneser-Ney model per language (``char_kn``) is counted over every
document of that language; a document's score is the mean negative log
probability per word (``log_perplexity``) under its own language's model, whose grams cross word borders.  Upper and lower bands are the language's median -/+ ``BAND`` robust
standard deviations (1.4826 times the median absolute deviation, of at least ``LEAST_MAD``), over its
documents of at least 50 words.  There, documents with one sketch (the least hash of their 3-word
windows) count once, with their median: exact copies always, near copies nearly
always have one, so a large group of them does not set its language's band.  A
document outside its band is rejected.

Base columns: words ``[^\\x20\\x09-\\x0D]+``; ``word_chars`` code points in
words; ``n_symbols`` characters of ``[#*$%&|<>]``; ``n_dup_lines`` lines
(split at \\n) with a word that equal an earlier line; ``n_repeat_words`` words
in a 3-word window found at least twice in the text.

Defined cases: a null text has no words (base rules reject it); a null
language is a language of its own; repeated rows give one row each, and count
each time in the model and once in the bands; no rows give no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from babelcask.llm import char_kn as K
from babelcask.llm import tokens as T
from babelcask.llm.work import Staging

MIN_WORDS = 50
BAND = 6.5
#: Natural log units a word; ordinary languages have 0.17 to 0.25.
LEAST_MAD = 0.1
NO_LANG = ""

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    return len(lines) - len(set(lines))


def _running(marks: np.ndarray) -> np.ndarray:
    """How many marks lie before each byte; 32 bits, as no text column's bytes in a chunk reach 2**31."""
    out = np.zeros(len(marks) + 1, np.int32)
    np.cumsum(marks, out=out[1:])
    return out


def base_counts(w: T.Words, texts: list[str]) -> dict[str, np.ndarray]:
    """Base columns of a chunk of texts."""
    n_words = np.diff(w.rows)
    letters = _running((w.data & 0xC0) != 0x80)     # code points begun so far
    in_words = np.concatenate([[0], np.cumsum(letters[w.ends] - letters[w.starts])])
    symbols = _running(_SYMBOL[w.data])
    grams = T.gram_hashes(w.hashes(), 3)
    owner = w.owner()
    repeated = np.zeros(len(w.starts), bool)
    sketch = np.zeros(len(n_words), np.uint64)
    if len(grams):
        inside = np.flatnonzero(owner[:-2] == owner[2:])
        some = np.flatnonzero(n_words >= 3)
        if len(some):
            sketch[some] = np.minimum.reduceat(grams[inside], np.searchsorted(inside, w.rows[some]))
        key = T.mix(grams[inside] + owner[inside].astype(np.uint64) * T._STEP)
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(key) else np.zeros(0, bool)
        at = inside[order[twice]]
        for k in range(3):
            repeated[at + k] = True
    marks = np.concatenate([[0], np.cumsum(repeated)])
    return {
        "n_words": n_words.astype(np.int64),
        "word_chars": in_words[w.rows[1:]] - in_words[w.rows[:-1]],
        "n_symbols": (symbols[w.texts[1:]] - symbols[w.texts[:-1]]).astype(np.int64),
        "n_dup_lines": np.array([duplicate_lines(t or "") for t in texts], np.int64),
        "n_repeat_words": marks[w.rows[1:]] - marks[w.rows[:-1]],
        "sketch": sketch.view(np.int64),
    }


def _counter(langs: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, last, w in K.rows_of(batches, lower=False):
            codes = K.class_codes(batch.column("lang").slice(first, last - first), langs)
            cls, g, n = K.count_grams(w, codes[w.owner()])
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(g.astype(np.int64)), pa.array(n)], names=["cls", "g", "c"])
    return run


SCORED = ("doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, sketch long, log_prob double")


def _scorer(langs: dict[str, int], model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = K.HashArrays(model.value) if model is not None else None
        for batch, first, last, w in K.rows_of(batches, lower=False):
            part = batch.slice(first, last - first)
            base = base_counts(w, part.column("text").to_pylist())
            if arrays is not None and len(w.starts):
                codes = K.class_codes(part.column("lang"), langs)[w.owner()]
                p = K.pieces(w, codes)
                cls = codes[p.word][p.owner]
                one, gram = K.distinct_grams(p.window, p.length, cls)
                of_word = p.of_words(arrays.log_prob(p.window[one], p.length[one], cls[one])[gram])
                total = np.concatenate([[0.0], np.cumsum(of_word)])
                log_prob = total[w.rows[1:]] - total[w.rows[:-1]]
            else:
                log_prob = np.zeros(len(part), np.float64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("lang"), *[pa.array(c) for c in base.values()],
                 pa.array(log_prob)], names=["doc_id", "lang", *base, "log_prob"])
    return run


def _joined_scores(texts: DataFrame, codes: DataFrame, model: DataFrame) -> DataFrame:
    """(row, log_prob) by joins: the way for a model too large to hand out."""
    each = (texts.join(codes, "lang").select("row", "cls", "text")
            .mapInArrow(K.speller(["row", "cls"], lower=False), "row long, cls long, at long, b binary, skip int")
            .groupBy("row", "cls", "b", "skip").agg(F.count("*").alias("n")))
    known = K.piece_log_probs(each.select("cls", "b", "skip").distinct(), model)
    return (each.join(known, ["cls", "b", "skip"]).groupBy("row")
            .agg(F.sum(F.col("n") * F.col("logp")).alias("log_prob")))


def score(docs: DataFrame, local_rows: int = K.MAX_LOCAL_ROWS, corpus: DataFrame | None = None) -> DataFrame:
    """Base columns, ``log_perplexity``, the language's bands and the verdict for every document.

    ``docs(doc_id, text, lang)``; ``local_rows``: a larger model is joined instead of handed out; ``corpus(text, lang)``:
    what the models learn from, if not ``docs`` (a language it lacks has 256 equally likely bytes).
    """
    spark = docs.sparkSession
    stage = Staging(spark, "perplexity")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("lang", F.lit(NO_LANG)).alias("lang"))
    # one row per language of the corpus; the driver needs their numbering only
    learnt = texts if corpus is None else corpus.select("text", F.coalesce("lang", F.lit(NO_LANG)).alias("lang"))
    seen = texts.select("lang") if corpus is None else texts.select("lang").union(learnt.select("lang"))
    langs = {r.lang: i for i, r in enumerate(seen.distinct().orderBy("lang").collect())}
    full = stage.write(learnt.select("text", "lang").mapInArrow(_counter(langs), "cls long, g long, c long")
                       .groupBy("cls", "g").agg(F.sum("c").alias("c")), "grams")
    model = K.fit(full, stage, "kn", len(langs))
    local = K.local_model(model, local_rows)
    if local is not None:
        handed = spark.sparkContext.broadcast(local)
        scored = stage.write(texts.mapInArrow(_scorer(langs, handed), SCORED), "scored")
    else:
        numbered = stage.write(texts.withColumn("row", F.monotonically_increasing_id()), "texts")
        codes = spark.createDataFrame(list(langs.items()), "lang string, cls long")
        summed = _joined_scores(numbered.select("row", "text", "lang"), codes, model)
        schema = SCORED
        base = numbered.select(F.col("row").alias("doc_id"), "text", "lang").mapInArrow(_scorer(langs, None), schema)
        scored = stage.write(
            base.drop("log_prob").withColumnRenamed("doc_id", "row")
            .join(numbered.select("row", "doc_id"), "row").join(summed, "row", "left")
            .select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "sketch",
                    F.coalesce("log_prob", F.lit(0.0)).alias("log_prob")), "scored")
    return banded(scored)


def banded(scored: DataFrame) -> DataFrame:
    nll = F.when(F.col("n_words") > 0, -F.col("log_prob") / F.col("n_words"))
    rows = scored.withColumn("log_perplexity", nll)
    # copies count once: their number would set the band
    long = (rows.filter(F.col("n_words") >= MIN_WORDS).groupBy("lang", "sketch")
            .agg(F.percentile_approx("log_perplexity", 0.5, 10000).alias("log_perplexity")))
    middle = long.groupBy("lang").agg(F.percentile_approx("log_perplexity", 0.5, 10000).alias("mid"))
    spread = (long.join(middle, "lang").groupBy("lang", "mid")
              .agg(F.percentile_approx(F.abs(F.col("log_perplexity") - F.col("mid")), 0.5, 10000).alias("mad")))
    width = BAND * 1.4826 * F.greatest("mad", F.lit(LEAST_MAD))
    bands = spread.select("lang", (F.col("mid") - width).alias("lower_band"), (F.col("mid") + width).alias("upper_band"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = F.col("log_perplexity").between(F.col("lower_band"), F.col("upper_band"))
    return (rows.join(bands, "lang", "left").withColumn("base_failed", failed)
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"),
                    "log_perplexity", "lower_band", "upper_band"))
