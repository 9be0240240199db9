"""Benchmark decontamination by spaced seeds.

A mask selects some positions of a window of words, so a seed still matches
when words at the ignored positions were replaced.  Seeds of the benchmark
items and of the documents are joined on their hash; around every hit the
document is laid along the item and the overlap is verified on the words
themselves, with substitutions allowed.

* Words: ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, ASCII punctuation ignored.
* Masks: fixed values below (weight 6, span up to 11).  An item of fewer words
  than a mask's span uses the mask cut to the item, with at least 3 words
  selected; an item of 1 or 2 words has no seed and matches nothing.
* Verified overlap: the best-scoring stretch on the hit's diagonal (+1 per
  equal word, -2 per different one) must hold at least 13 equal words, or
  4/5 of the item if that is less, and 4/5 of its words must be equal.

Scale: a task tests its seeds against a filter of a fixed 2**26 bits made from
the benchmark seeds (no false negatives; with a large benchmark it only lets
more through), and only documents with a hit leave the scan.  The filter's
set bits are gathered as at most 2**20 longs, whatever the inputs' size.

Defined cases: a null text has no words; null ids stay null in the result;
repeated rows each give their rows; no rows on either side give no rows; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from babelcask.llm import tokens as T
from babelcask.llm.bitfilter import make_filter, passing
from babelcask.llm.work import Staging

#: 1 = the word counts, 0 = any word.
MASKS = ("111111", "1101100101", "10110010011")
MIN_EQUAL = 13
SHARE = (4, 5)

_MASKS = [np.flatnonzero([c == "1" for c in m]) for m in MASKS]


def _seed(words: np.ndarray, mask: int, picks: np.ndarray, span: int) -> np.ndarray:
    """Seed of every window of ``span`` words under a mask."""
    n = len(words) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, mask * 1000 + span, np.uint64)
    for j, k in enumerate(picks):
        total += words[k: k + n] * T._GRAM[j]
    return T.mix(total)


def _item_spans(n_words: int) -> list[tuple[int, np.ndarray, int]]:
    """(mask number, selected positions, span) usable for an item of that many words."""
    out = []
    for m, picks in enumerate(_MASKS):
        span = int(picks[-1]) + 1
        if n_words < span:
            picks, span = picks[picks < n_words], n_words
        if len(picks) >= 3:
            out.append((m, picks, span))
    return out


def _bench_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        item_ids = batch.column("item").to_pylist()
        for first, last, w in T.chunks(batch.column("text"), lower=True):
            hashes = w.hashes(skip_punctuation=True)
            cols = [[], [], [], [], []]
            for r in range(last - first):
                own = hashes[w.rows[r]: w.rows[r + 1]]
                for m, picks, span in _item_spans(len(own)):
                    seeds = _seed(own, m, picks, span)
                    cols[0].append(seeds.view(np.int64))
                    cols[1].append(np.full(len(seeds), item_ids[first + r], np.int64))
                    cols[2].append(np.arange(len(seeds), dtype=np.int32))
                    cols[3].append(np.full(len(seeds), m, np.int32))
                    cols[4].append(np.full(len(seeds), span, np.int32))
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols],
                                                 names=["seed", "item", "item_at", "mask", "span"])


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for first, last, w in T.chunks(batch.column("text"), lower=True):
            hashes = w.hashes(skip_punctuation=True)
            out += [hashes[w.rows[r]: w.rows[r + 1]].tobytes() for r in range(last - first)]
        yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(out, pa.binary())], names=["item", "item_words"])


def _scan(bits_broadcast, spans: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bits_broadcast.value
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, last, w in T.chunks(batch.column("text"), lower=True):
                hashes = w.hashes(skip_punctuation=True)
                owner = w.owner()
                found = []
                for m, span in spans:
                    picks = _MASKS[m][_MASKS[m] < span]
                    seeds = _seed(hashes, m, picks, span)
                    at = passing(bits, seeds)
                    at = at[owner[at] == owner[at + span - 1]]  # a window inside one text
                    found.append((at, seeds[at]))
                at = np.concatenate([a for a, _ in found]) if found else np.zeros(0, np.int64)
                if not len(at):
                    continue
                seeds = np.concatenate([s for _, s in found])
                order = np.lexsort((at, owner[at]))
                at, seeds = at[order], seeds[order]
                docs, begin = np.unique(owner[at], return_index=True)
                edges = np.append(begin, len(at)).astype(np.int32)
                local = (at - w.rows[owner[at]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[first + d] for d in docs], pa.int64()),
                    pa.array([hashes[w.rows[d]: w.rows[d + 1]].tobytes() for d in docs], pa.binary()),
                    pa.ListArray.from_arrays(edges, pa.array(seeds.view(np.int64))),
                    pa.ListArray.from_arrays(edges, pa.array(local))],
                    names=["doc_id", "doc_words", "seeds", "places"])
    return run


def best_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, end, equal words) of the stretch with the largest sum of +1 / -2; first one on ties."""
    score = np.concatenate([[0], np.cumsum(np.where(equal, 1, -2))])
    low = np.minimum.accumulate(score)
    end = int(np.argmax(score - low))
    start = int(np.flatnonzero(score[: end + 1] == low[end])[-1])
    return start, end, int(np.count_nonzero(equal[start:end]))


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """Verified overlap (start, end in the document, equal words) on one diagonal, or nothing."""
    lo, hi = max(0, diagonal), min(len(doc), diagonal + len(item))
    if hi <= lo:
        return None
    start, end, same = best_stretch(doc[lo:hi] == item[lo - diagonal: hi - diagonal])
    need = min(MIN_EQUAL, -(-SHARE[0] * len(item) // SHARE[1]))
    if same < need or SHARE[1] * same < SHARE[0] * (end - start):
        return None
    return lo + start, lo + end, same


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, item, words, item_words, diagonals in zip(
                batch.column("doc_id").to_pylist(), batch.column("item").to_pylist(), batch.column("doc_words"),
                batch.column("item_words"), batch.column("diagonals").to_pylist(), strict=True):
            doc = np.frombuffer(words.as_buffer(), np.uint64)
            bench = np.frombuffer(item_words.as_buffer(), np.uint64)
            hits = [h for d in sorted(diagonals) if (h := overlap(doc, bench, d))]
            if hits:
                start, end, same = max(hits, key=lambda h: (h[2], -h[0]))
                rows.append((doc_id, item, start, end, same, len(bench), len(hits)))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _MATCH_TYPES, strict=True)], names=_MATCH_NAMES)


_MATCH_NAMES = ["doc_id", "item_id", "start_word", "end_word", "equal_words", "item_words", "places"]
_MATCH_TYPES = [pa.int64(), pa.int64(), *[pa.int32()] * 5]
MATCH = "doc_id long, item_id long, start_word int, end_word int, equal_words int, item_words int, places int"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, overlap) for every document and benchmark item with a verified overlap.

    ``docs(doc_id, text)``, ``benchmark(item_id, text)``.
    """
    spark = docs.sparkSession
    stage = Staging(spark, "decontaminate")
    items = benchmark.select(F.col("item_id").cast("long").alias("item"), "text")
    seeds = stage.write(items.mapInArrow(_bench_seeds, "seed long, item long, item_at int, mask int, span int"), "seeds")
    bits = spark.sparkContext.broadcast(make_filter(seeds.select("seed")))
    spans = sorted((r.mask, r.span) for r in seeds.select("mask", "span").distinct().collect())  # at most 3 x 11
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hit_docs = stage.write(
        texts.mapInArrow(_scan(bits, spans), "doc_id long, doc_words binary, seeds array<long>, places array<int>")
        .withColumn("row", F.monotonically_increasing_id()), "hits")
    hits = (hit_docs.select("row", F.explode(F.arrays_zip("seeds", "places")).alias("h"))
            .select("row", F.col("h.seeds").alias("seed"), F.col("h.places").alias("place")))
    diagonals = (hits.join(seeds, "seed").select("row", "item", (F.col("place") - F.col("item_at")).alias("d"))
                 .groupBy("row", "item").agg(F.collect_set("d").alias("diagonals")))
    words = items.mapInArrow(_item_words, "item long, item_words binary")
    full = (diagonals.join(words, "item").join(hit_docs.select("row", "doc_id", "doc_words"), "row")
            .select("doc_id", "item", "doc_words", "item_words", "diagonals"))
    return full.mapInArrow(_verify, MATCH)
