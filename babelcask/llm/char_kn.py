"""Modified Kneser-Ney models over the bytes of texts, counted by Spark, kept as sorted hash arrays.

A text is read as ``START word blank word blank ...``: each run of white space is one
blank.  Every byte after START is predicted from at most ``ORDER - 1`` bytes
before it, across word borders, so the order of words has a part in a text's
probability.  A gram of L bytes is one long: ``L << 40 | bytes``.

Work per chunk of text is on distinct pieces of it (``Pieces``): the first predictions of a word
depend on at most three bytes of what stands before it (a border piece), the
others on the word alone (an inner piece).

Counting: tasks send (class, gram, n) per chunk of text, combined before the
shuffle.  ``fit`` makes, level by level, the counts of Kneser-Ney (raw at the
top and for grams that begin a text, else the number of different bytes that
precede), the three discounts per class and level, and the interpolated
probabilities, all as DataFrame joins on (class, gram).

``fit_shared`` pools the classes in one model and gives each class a top level
of its own that backs off to the pooled one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from babelcask.llm import tokens as T
from babelcask.llm.work import Staging

ORDER = 5
#: Predictions of a word whose context reaches the bytes before it.
HEAD = 4
#: Begins a text; in no word.
START = 0x0A
_BEFORE, _AFTER = 4, 8
U64 = np.uint64
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(ORDER + 1)], np.uint64)
#: A model of more rows is not gathered for broadcast: scoring joins it instead (16 bytes a row).
MAX_LOCAL_ROWS = 6_000_000
CHUNK_BYTES = 4_000_000
#: Discounts (one row a class, 32 bytes) of more classes are joined by shuffle.
BROADCAST_CLASSES = 100_000
#: Words spelled out in one batch.
SPELL_WORDS = 500_000


# ---- grams of texts (numpy) -------------------------------------------------------------------------

def _stream(w: T.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts as they are read, place before each word, place of START of each word's text).

    ``_BEFORE`` zeros precede and ``_AFTER`` follow.
    """
    sizes = w.ends - w.starts
    per = np.diff(w.rows)
    some = np.flatnonzero(per)
    gap = np.cumsum(sizes + 1) - (sizes + 1) + np.repeat(np.arange(len(some)), per[some]) + _BEFORE
    total = int(sizes.sum()) + len(sizes) + len(some)
    flat = np.full(total + _BEFORE + _AFTER, 0x20, np.uint8)
    flat[:_BEFORE] = flat[_BEFORE + total:] = 0
    inside = np.zeros(len(flat), bool)
    inside[_BEFORE: _BEFORE + total] = True
    inside[gap] = False
    inside[(gap + sizes + 1)[w.rows[1:][some] - 1]] = False
    flat[inside] = w.data[~T._SPACE[w.data]]
    begin = gap[w.rows[:-1][some]]
    flat[begin] = START
    return flat, gap, np.repeat(begin, per[some])


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places of the runs ``[start, start + count)``, run after run."""
    return np.arange(int(counts.sum())) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


@dataclass
class Pieces:
    """Distinct pieces of a chunk and their predictions."""

    window: np.ndarray    # per prediction: its gram's last bytes
    length: np.ndarray    # and their number
    owner: np.ndarray     # and the piece
    word: np.ndarray      # per piece: a word that has it
    n: np.ndarray         # and how many have it
    border: np.ndarray    # per word: its border piece
    inner: np.ndarray     # and its inner piece

    def of_words(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value per prediction over each word's predictions."""
        total = np.bincount(self.owner, weights=values, minlength=len(self.n))
        return total[self.border] + total[self.inner]


def _border_keys(flat: np.ndarray, gap: np.ndarray, begin: np.ndarray, said: np.ndarray) -> np.ndarray:
    """Hash of three bytes before a word's gap, the gap and the word's first predicted bytes."""
    eight = np.ndarray((len(flat) - 7,), "<u8", flat.data, strides=(1,))[gap - 3].astype(np.uint64)
    absent = (8 * np.maximum(3 - (gap - begin), 0)).astype(np.uint64)
    beyond = (8 * (HEAD - said)).astype(np.uint64)
    eight = (eight >> absent) << (absent + beyond)
    return T.mix(eight + said.astype(np.uint64) * T._STEP)


def pieces(w: T.Words, classes: np.ndarray | None = None) -> Pieces:
    """Pieces of a chunk; those of different classes (per word) differ."""
    flat, gap, begin = _stream(w)
    sizes = w.ends - w.starts
    said = np.minimum(sizes + 1, HEAD)
    first, n, group = distinct(_border_keys(flat, gap, begin, said), classes)
    first2, n2, group2 = distinct(w.hashes(), classes)
    word = np.concatenate([first, first2])
    counts = np.concatenate([said[first], (sizes + 1 - said)[first2]])
    at = _ranges(np.concatenate([gap[first] + 1, (gap + HEAD + 1)[first2]]), counts)
    window = flat[at].astype(np.uint64)
    for k in range(1, ORDER):
        window |= flat[at - k].astype(np.uint64) << U64(8 * k)
    owner = np.repeat(np.arange(len(word)), counts)
    length = np.minimum(at - begin[word][owner] + 1, ORDER)
    return Pieces(window & _MASKS[length], length, owner, word, np.concatenate([n, n2]), group, len(first) + group2)


def spelled(w: T.Words, first: int, last: int) -> tuple[pa.Array, np.ndarray]:
    """(bytes, number of leading bytes that are context only) of the border pieces of words ``first`` to ``last``,
    then of their inner pieces; what has no prediction is no longer than its context."""
    flat, gap, begin = _stream(w)
    gap, begin, sizes = gap[first:last], begin[first:last], (w.ends - w.starts)[first:last]
    tail = np.minimum(gap - begin, 3)
    starts = np.concatenate([gap - tail, gap + 1])
    counts = np.concatenate([tail + 1 + np.minimum(sizes + 1, HEAD), sizes + 1])
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    data = pa.py_buffer(flat[_ranges(starts, counts)])
    spelt = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), data])
    return spelt, np.concatenate([tail + 1, np.full(last - first, HEAD)]).astype(np.int32)


def pack(window: np.ndarray, length) -> np.ndarray:
    return (np.asarray(length, np.uint64) << U64(40)) | (window & _MASKS[length])


def distinct(hashes: np.ndarray, classes: np.ndarray | None = None):
    """(first place, number of each, group of each hash); hashes of different classes differ."""
    key = hashes if classes is None else T.mix(hashes + (classes.astype(np.uint64) + U64(1)) * T._STEP)
    _, first, group, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return first, n, group


def distinct_grams(window: np.ndarray, length: np.ndarray, classes: np.ndarray | None = None):
    """(first place of each distinct gram, number of each prediction's gram); grams of different classes differ."""
    key = pack(window, length)
    if classes is not None:
        key = key | ((classes + 1).astype(np.uint64) << U64(44))
    _, first, group = np.unique(key, return_index=True, return_inverse=True)
    return first, group


def count_grams(w: T.Words, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, packed gram, n) of a chunk; ``classes`` per word, negative: not counted."""
    if not (classes >= 0).any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    p = pieces(w, classes)
    cls = classes[p.word][p.owner]
    used = np.flatnonzero(cls >= 0)
    key = pack(p.window[used], p.length[used]) | (cls[used].astype(np.uint64) << U64(44))
    order = np.argsort(key)
    key, weight = key[order], p.n[p.owner[used]][order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key, total = key[at], np.add.reduceat(weight, at)
    return (key >> U64(44)).astype(np.int64), key & U64((1 << 44) - 1), total


# ---- fit (Spark) ------------------------------------------------------------------------------------

def _length(g: Column) -> Column:
    return F.shiftright(g, 40)


def _context(g: Column) -> Column:
    """The gram without its last byte."""
    tail = F.shiftright(g.bitwiseAND(F.lit((1 << 40) - 1)), 8)
    return F.shiftleft(_length(g) - 1, 40).bitwiseOR(tail)


def _suffix(g: Column) -> Column:
    """The gram without its first byte."""
    keep = F.expr("shiftleft(1L, CAST(8 * (shiftright(g, 40) - 1) AS INT)) - 1")
    return F.shiftleft(_length(g) - 1, 40).bitwiseOR(g.bitwiseAND(keep))


def _discounts(counts: DataFrame) -> DataFrame:
    """(cls, d1, d2, d3) of one level, from how many grams were counted 1 to 4 times."""
    n = counts.groupBy("cls").agg(*[F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in range(1, 5)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    # greatest() passes over nulls: the rule for levels too small to estimate comes first
    cut = lambda k: F.coalesce(
        F.when((F.col(f"n{k}") > 0) & (F.col("n1") > 0) & (F.col("n2") > 0),
               k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")), F.lit(0.5 * k))
    return n.select("cls", *[F.least(F.lit(0.95 * k), F.greatest(F.lit(0.1), cut(k))).alias(f"d{k}") for k in (1, 2, 3)])


def _discounted(counts: DataFrame, classes: int) -> tuple[DataFrame, DataFrame]:
    """Of one level: (cls, g, ctx, share) discounted shares, (cls, ctx, bow) mass left per context."""
    cut = (F.when(F.col("c") >= 3, F.col("d3")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d1")))
    cuts = _discounts(counts)
    # a shuffle on the class would deal all rows to a few tasks
    if classes <= BROADCAST_CLASSES:
        cuts = F.broadcast(cuts)
    rows = (counts.join(cuts, "cls")
            .select("cls", "g", _context(F.col("g")).alias("ctx"), "c", cut.alias("cut")))
    ctx = (rows.groupBy("cls", "ctx")
           .agg(F.sum("c").alias("total"), (F.sum("cut") / F.sum("c")).alias("bow")))
    shares = rows.join(ctx, ["cls", "ctx"]).select(
        "cls", "g", ((F.col("c") - F.col("cut")) / F.col("total")).alias("share"), "bow")
    return shares, ctx.select("cls", F.col("ctx").alias("g"), "bow")


def fit(full: DataFrame, stage: Staging, name: str, classes: int | None = None) -> DataFrame:
    """``full(cls, g, c)`` -> model rows (cls, kind, g, value): kind 0 log probability, 1 log backoff weight.

    ``classes``: how many there are at most; counted if not given.
    """
    if classes is None:
        classes = full.select("cls").distinct().count()
    counts, types = {}, None
    for level in range(ORDER, 0, -1):
        raw = full.filter(_length(F.col("g")) == level)
        if types is not None:
            # shorter grams counted are those that begin with START: no byte before, so none of them is among the types
            raw = raw.union(types)
        counts[level] = stage.write(raw, f"{name}_counts{level}")
        if level > 1:
            types = (counts[level].groupBy("cls", _suffix(F.col("g")).alias("g"))
                     .agg(F.count("*").alias("c")).select("cls", "g", "c"))
    parts, lower = [], None
    for level in range(1, ORDER + 1):
        shares, bows = _discounted(counts[level], classes)
        if lower is None:
            prob = shares.select("cls", "g", (F.col("share") + F.col("bow") / 256).alias("p"))
        else:
            below = lower.select("cls", F.col("g").alias("s"), F.col("p").alias("q"))
            prob = (shares.withColumn("s", _suffix(F.col("g"))).join(below, ["cls", "s"])
                    .select("cls", "g", (F.col("share") + F.col("bow") * F.col("q")).alias("p")))
        lower = stage.write(prob, f"{name}_p{level}")
        parts.append(lower.select("cls", F.lit(0).alias("kind"), "g", F.ln("p").cast("float").alias("value")))
        parts.append(bows.select("cls", F.lit(1).alias("kind"), "g", F.ln("bow").cast("float").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return stage.write(out, f"{name}_model")


SHARED = -1


def fit_shared(full: DataFrame, stage: Staging, name: str, classes: int) -> DataFrame:
    """Pooled model (class -1) plus, per class, log discounted shares (kind 0) and log backoff weights (kind 1).

    A class's probability of a gram is ``share + backoff * pooled probability``.
    """
    pooled = (full.groupBy("g").agg(F.sum("c").alias("c"))
              .select(F.lit(SHARED).cast("long").alias("cls"), "g", "c"))
    shared = fit(pooled, stage, f"{name}_pooled", 1)
    shares, bows = _discounted(full, classes)
    return stage.write(
        shared.union(shares.select("cls", F.lit(0), "g", F.ln("share").cast("float")))
        .union(bows.select("cls", F.lit(1), "g", F.ln("bow").cast("float"))), f"{name}_model")


# ---- scoring (numpy, model at hand) ------------------------------------------------------------------

class HashArrays:
    """Model rows as one sorted array of 64-bit hashes of (class, kind, gram) and one of values."""

    def __init__(self, rows: pa.Table):
        cls = rows.column("cls").to_numpy().astype(np.int64)
        g = rows.column("g").to_numpy().astype(np.uint64)
        keys = self.key(g, cls, rows.column("kind").to_numpy())
        order = np.argsort(keys)
        self.keys = keys[order]
        self.values = rows.column("value").to_numpy().astype(np.float32)[order]

    @staticmethod
    def key(g: np.ndarray, cls, kind) -> np.ndarray:
        tag = (np.asarray(cls, np.int64) + 2).astype(np.uint64) * U64(2) + np.asarray(kind, np.uint64)
        return T.mix(g ^ (tag << U64(44)))

    def find(self, g: np.ndarray, cls, kind: int) -> np.ndarray:
        """Values; nan where the model has none."""
        keys = self.key(g, cls, kind)
        if not len(self.keys):
            return np.full(len(keys), np.nan, np.float32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], np.float32(np.nan))

    def log_prob(self, window: np.ndarray, length: np.ndarray, cls) -> np.ndarray:
        """Log probability of each prediction: the longest gram known, else backoff weights of its contexts."""
        out = np.zeros(len(window), np.float64)
        todo = np.arange(len(window))
        cls = np.broadcast_to(np.asarray(cls, np.int64), len(window))
        length = length.copy()
        while len(todo):
            n = length[todo]
            value = self.find(pack(window[todo], n), cls[todo], 0)
            known = ~np.isnan(value)
            out[todo[known]] += value[known]
            todo, n = todo[~known], n[~known]
            if not len(todo):
                break
            context = pack(window[todo] >> U64(8), n - 1)
            out[todo] += np.nan_to_num(self.find(context, cls[todo], 1))
            last = n == 1
            out[todo[last]] -= np.log(256.0)
            length[todo] -= 1
            todo = todo[~last]
        return out


def local_model(model: DataFrame, limit: int = MAX_LOCAL_ROWS) -> pa.Table | None:
    """The model's rows if they are at most ``limit`` (their number is counted first), else nothing."""
    return model.toArrow() if model.count() <= limit else None


# ---- scoring (Spark, model of any size) ---------------------------------------------------------------

def predictions_of(pieces: DataFrame) -> DataFrame:
    """``pieces(b, skip, ...)`` with the place ``i`` (from 1) of each predicted byte."""
    return (pieces.filter(F.octet_length("b") > F.col("skip"))
            .withColumn("i", F.explode(F.sequence(F.col("skip") + 1, F.octet_length("b")))))


def piece_log_probs(pieces: DataFrame, model: DataFrame) -> DataFrame:
    """``pieces(cls, b, skip)``, distinct -> (cls, b, skip, logp) by joins with the model; any size of model."""
    at = predictions_of(pieces)
    levels = at.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(ORDER), F.col("i")))).alias("n"))
    number = lambda part: F.conv(F.hex(part), 16, 10).cast("long")
    size = F.col("n").cast("long")
    grams = levels.select(
        "cls", "b", "skip", "i", "n",
        F.shiftleft(size, 40).bitwiseOR(number(F.substring("b", F.col("i") - F.col("n") + 1, F.col("n")))).alias("g"),
        F.shiftleft(size - 1, 40).bitwiseOR(F.when(F.col("n") == 1, F.lit(0).cast("long")).otherwise(
            number(F.substring("b", F.col("i") - F.col("n") + 1, F.col("n") - 1)))).alias("h"))
    probs = model.filter("kind = 0").select("cls", "g", F.col("value").alias("p"))
    bows = model.filter("kind = 1").select("cls", F.col("g").alias("h"), F.col("value").alias("bow"))
    found = grams.join(probs, ["cls", "g"], "left").join(bows, ["cls", "h"], "left")
    # per prediction: the longest known gram's probability and the backoff weights of the longer ones
    rows = (found.groupBy("cls", "b", "skip", "i").agg(
        F.max(F.when(F.col("p").isNotNull(), F.struct("n", "p"))).alias("best"),
        F.collect_list(F.struct("n", F.coalesce("bow", F.lit(0.0).cast("float")).alias("bow"))).alias("bows")))
    top = F.coalesce(F.col("best.n"), F.lit(0))
    logp = (F.coalesce(F.col("best.p").cast("double"), F.lit(-float(np.log(256.0))))
            + F.aggregate("bows", F.lit(0.0), lambda s, x: s + F.when(x["n"] > top, x["bow"].cast("double")).otherwise(0.0)))
    return rows.select("cls", "b", "skip", logp.alias("lp")).groupBy("cls", "b", "skip").agg(F.sum("lp").alias("logp"))


def class_codes(names: pa.Array, known: dict[str, int]) -> np.ndarray:
    """Number of each row's class; -1 for a null or unknown one."""
    coded = names.dictionary_encode() if not isinstance(names, pa.ChunkedArray) else names.combine_chunks().dictionary_encode()
    table = np.array([known.get(x, -1) for x in coded.dictionary.to_pylist()] + [-1], np.int64)
    return table[coded.indices.fill_null(len(table) - 1).to_numpy(zero_copy_only=False)]


def rows_of(batches: Iterator[pa.RecordBatch], lower: bool) -> Iterator[tuple[pa.RecordBatch, int, int, T.Words]]:
    for batch in batches:
        for first, last, w in T.chunks(batch.column("text"), lower=lower, limit=CHUNK_BYTES):
            yield batch, first, last, w


def speller(carry: list[str], lower: bool):
    """Rows of (*carry, at, b, skip) of ``(*carry, text)``: the pieces of every word, ``at`` its number in the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, last, w in rows_of(batches, lower):
            part = batch.slice(first, last - first).select(carry)
            owner = w.owner()
            for i in range(0, len(owner), SPELL_WORDS):
                j = min(i + SPELL_WORDS, len(owner))
                b, skip = spelled(w, i, j)
                who = np.tile(owner[i:j], 2)
                at = np.tile(np.arange(i, j) - w.rows[owner[i:j]], 2)
                rows = part.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(at), b, pa.array(skip)],
                                                 names=[*carry, "at", "b", "skip"])
    return run
