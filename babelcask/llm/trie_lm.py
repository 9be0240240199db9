"""Language-model scores from Elias-Fano n-gram tries.

Tokens: words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, then one end token per
text; a text begins after a start context.  The model has three orders:

    p1(w)     = (c(w) - 0.5) / N,  0.5 V / N for all unknown words together
    p(w|v)    = (c(vw) + MU p1(w)) / (c(v) + MU)
    p(w|u v)  = (c(uvw) + MU p(w|v)) / (c(uv) + MU),  p(w|v) for the first token of a text

``score`` sums p(w|u v), ``pair_score`` sums p(w|v).

Training texts are those whose crc32(doc_id as text) mod 10 is not 0; a null id
is not learned from.  Log probabilities are quantised to 1/4096 of a decade
(16 bits).  ``base_score`` is exact: add-0.1 unigrams.

Scale: nothing holds the model whole.  Tasks cut texts into blocks and name
each distinct word once per block; the blocks stay in a table bucketed by
block.  Words go to parts by their hash, which number them (frequent words
low) and count them; then each block sends its distinct word pairs, with its
training counts, to the part of their context.  A context with more than 1/parts
of all tokens is split over all parts by its successors.  A part
merges the counts, builds the trie of its contexts (monotone pointers, successors raised
to be monotone, quantised probabilities; ``elias_fano``) in a mapped file,
answers every block's pairs by successor search inside the context's range,
and the answers go back to the blocks in the order asked, with the training
count of each pair.  Then triples go the same way, to the part of their first two words:
a context once with its count, its successors with their counts and p(w|v); the part
ranks its contexts and builds a trie over the ranks.  A pair found in every text
is one entry per block.

Defined cases: a null text has the end token only; repeated rows are each
learned from and scored; without a training text every count is 0; no rows
give no rows; other columns are not looked at.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from babelcask.llm import tokens as T
from babelcask.llm.elias_fano import Trie
from babelcask.llm.numpack import halves, joined, pack, unpack
from babelcask.llm.work import Staging, bucketed
from babelcask.session import input_bytes, shuffle_partitions

MU = 2000.0
DISCOUNT = 0.5
STEP = 4096
HELD_OUT = 10
BLOCK_BYTES = 13_000_000
PART_BYTES = 2_000_000
#: Input bytes per part of the model; one task holds one part.
MODEL_PART_BYTES = 8 << 20
START, END, UNKNOWN, FIRST = 0, 1, 2, 3      # numbers of the special tokens; words begin at FIRST
U64 = np.uint64


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % HELD_OUT == 0


# ---- blocks --------------------------------------------------------------------------------------------------

BLOCK = "block long, doc_ids array<long>, words binary, per_text binary, numbers binary"


def _make_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of about ``BLOCK_BYTES`` of a task's texts, over the borders of its batches: larger blocks repeat fewer words."""
    ids, hashes, counts, held = [], [], [], 0
    for batch in batches:
        names = batch.column("doc_id").to_pylist()
        for lo, hi, w in T.chunks(batch.column("text"), lower=True, limit=PART_BYTES):
            ids += names[lo:hi]
            hashes.append(w.hashes())
            counts.append(np.diff(w.rows))
            held += len(w.data)
            if held >= BLOCK_BYTES:
                yield _block(ids, np.concatenate(hashes), np.concatenate(counts))
                ids, hashes, counts, held = [], [], [], 0
    if ids:
        yield _block(ids, np.concatenate(hashes), np.concatenate(counts))


def _block(ids: list, words: np.ndarray, per_text: np.ndarray) -> pa.RecordBatch:
    learns = np.array([not is_held_out(i) for i in ids])
    known, number, times = np.unique(words, return_inverse=True, return_counts=True)
    learned = np.bincount(number[np.repeat(learns, per_text)], minlength=len(known))
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return pa.RecordBatch.from_arrays([
        pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
        pa.array([pack(known[order], learned[order])], pa.binary()), pa.array([pack(per_text)], pa.binary()),
        pa.array([pack(rank[number])], pa.binary())], names=["block", "doc_ids", "words", "per_text", "numbers"])


# ---- words: numbers and counts --------------------------------------------------------------------------------

def _part_of_word(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (hashes % U64(parts)).astype(np.int64)


ASKED = "part int, of_block long, asked binary"


def _ask_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("words").to_pylist(), strict=True):
                hashes, learned = unpack(blob)
                part = _part_of_word(hashes, parts)
                rows = [(p, block, pack(hashes[part == p], learned[part == p])) for p in np.unique(part).tolist()]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)],
                        names=["part", "of_block", "asked"])
    return run


ANSWERED = "part int, of_block long, kind int, answer binary, n_tokens long, n_types long"
_ANSWERED = pa.schema([("part", pa.int32()), ("of_block", pa.int64()), ("kind", pa.int32()), ("answer", pa.binary()),
                       ("n_tokens", pa.int64()), ("n_types", pa.int64())])
WORDS, PAIRS, TRIPLES = 0, 1, 2


def _answer_words(parts: int):
    def run(group: pa.Table) -> pa.Table:
        """Counts of one part's words; its numbers go by falling count, so frequent words are low in every part."""
        part = group.column("part")[0].as_py()
        blocks = group.column("of_block").to_pylist()
        asked = [unpack(b) for b in group.column("asked").to_pylist()]
        hashes = np.concatenate([a[0] for a in asked])
        known, place = np.unique(hashes, return_inverse=True)
        total = np.zeros(len(known), np.int64)
        np.add.at(total, place, np.concatenate([a[1] for a in asked]).astype(np.int64))
        order = np.lexsort((known, -total))
        number = np.empty(len(known), np.int64)
        number[order] = np.arange(len(known)) * parts + part + FIRST
        ends = np.cumsum([len(a[0]) for a in asked])
        answers = [pack(number[i], total[i]) for i in np.split(place, ends[:-1])]
        tokens, types = [0] * len(blocks), [0] * len(blocks)
        tokens[0], types[0] = int(total.sum()), int(np.count_nonzero(total))
        return pa.Table.from_arrays([
            pa.array([part] * len(blocks), pa.int32()), pa.array(blocks, pa.int64()), pa.array([WORDS] * len(blocks), pa.int32()),
            pa.array(answers, pa.binary()), pa.array(tokens, pa.int64()), pa.array(types, pa.int64())], schema=_ANSWERED)
    return run


# ---- pairs ------------------------------------------------------------------------------------------------------

class Block:
    """One block with the numbers and counts of its words."""

    def __init__(self, row: dict, answers: dict[int, bytes], parts: int, n_train: int):
        hashes, _ = unpack(row["words"])
        part = _part_of_word(hashes, parts)
        self.number = np.zeros(len(hashes), np.int64)
        count = np.zeros(len(hashes), np.int64)
        for p, blob in answers.items():
            number, n = unpack(blob)
            self.number[part == p], count[part == p] = number, n
        self.number[count == 0] = UNKNOWN
        self.doc_ids = row["doc_ids"]
        self.held = np.array([is_held_out(i) for i in self.doc_ids])
        per_text = unpack(row["per_text"])[0].astype(np.int64)
        self.local = unpack(row["numbers"])[0].astype(np.int32)
        # tokens with the end token after each text; n_train: number of training texts
        self.n_train = n_train
        self.sizes = per_text + 1
        ends = np.cumsum(self.sizes) - 1
        self.begins = ends - per_text
        is_end = np.zeros(int(self.sizes.sum()), bool)
        is_end[ends] = True
        self.is_begin = np.zeros(len(is_end), bool)
        self.is_begin[self.begins] = True
        self.word_at = np.flatnonzero(~is_end).astype(np.int32 if len(is_end) < 2**31 else np.int64)
        number, count = _narrow(self.number), _narrow(count)
        self.token = np.full(len(is_end), END, number.dtype)
        self.token[self.word_at] = number[self.local]
        self.times = _narrow(np.array([n_train])).repeat(len(is_end)).astype(np.result_type(count, _narrow(np.array([n_train]))))
        self.times[self.word_at] = count[self.local]
        self.learned = np.repeat(~self.held, self.sizes)

    def before(self, at: np.ndarray, column: np.ndarray, start: int) -> np.ndarray:
        """``column`` of the tokens before those at ``at``; ``start`` for the first of a text."""
        return np.where(self.is_begin[at], start, column[at - 1].astype(np.int64))

    def pairs(self, parts: int, n_tokens: int) -> dict[str, np.ndarray]:
        """Distinct pairs in the order of (context, successor), each with its part, and the place of each token's pair."""
        # words as ranks among the block's numbers: two ranks fit one key, in the order of the numbers
        names, rank = np.unique(np.concatenate([[START, END], self.number]), return_inverse=True)
        w = np.full(len(self.token), rank[1], np.int32)
        w[self.word_at] = rank[2:].astype(np.int32)[self.local]
        key = np.concatenate([rank[:1], w[:-1]]).astype(np.int64)
        key[self.begins] = rank[0]
        key *= len(names)
        key += w
        first, place, learned = _distinct(key, self.learned)
        del key, w
        out = {"v": self.before(first, self.token, START), "w": self.token[first].astype(np.int64), "n": learned,
               "cv": self.before(first, self.times, self.n_train), "cw": self.times[first].astype(np.int64)}
        # a context with over 1/parts of all tokens is dealt out by its successors
        hot = out["cv"] * parts > n_tokens
        dealt = T.mix(out["v"].astype(np.uint64) * T._STEP + np.where(hot, out["w"], 0).astype(np.uint64))
        return out | {"part": (dealt % U64(parts)).astype(np.int64), "place": place}

    def triples(self, p: dict[str, np.ndarray], counts: np.ndarray, parts: int, n_tokens: int) -> dict[str, np.ndarray]:
        """Distinct triples (``first``, ``second``: places of their pairs in ``p``) in the order of their tokens, each with
        its part, and the place of each token's triple, -1 for the first token of a text."""
        at = np.flatnonzero(~self.is_begin)
        key = p["place"][at - 1].astype(np.int64)
        key *= max(len(counts), 1)
        key += p["place"][at]
        first, place, learned = _distinct(key, self.learned[at])
        a, b = np.divmod(key[first], max(len(counts), 1))
        del key, first
        # as for pairs: a context with over 1/parts of all tokens is dealt out by its successors
        hot = counts[a] * parts > n_tokens
        dealt = T.mix(T.mix(p["v"][a].astype(np.uint64) * T._STEP + p["w"][a].astype(np.uint64)) * T._STEP
                      + np.where(hot, p["w"][b], 0).astype(np.uint64))
        of_token = np.full(len(self.token), -1, np.int32)
        of_token[at] = place
        return {"first": a, "second": b, "n": learned, "part": (dealt % U64(parts)).astype(np.int64), "place": of_token}


def _distinct(key: np.ndarray, weight: np.ndarray, runs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a place of each distinct key in their order, number of each row's key, sum of the weights per key).

    ``runs``: the keys are sorted runs one after the other, which a merge sort takes as they are.
    """
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
    order = np.argsort(key, kind="stable" if runs else None)
    ranked = key[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    begin = np.flatnonzero(new)
    number = np.empty(len(key), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    del ranked, new
    return order[begin], number, np.add.reduceat(weight[order], begin, dtype=np.int64)


def _narrow(x: np.ndarray) -> np.ndarray:
    """Numbers in 4 bytes where they fit."""
    return x.astype(np.uint32) if not len(x) or int(x.max()) < 1 << 32 else x.astype(np.int64)


def _by_part(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows by part, each part's in their order; edges of the parts)."""
    order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _joint(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """One key per pair of numbers, in the order of (high, low)."""
    top, bits = (int(x.max()) if len(x) else 0 for x in (high, low))
    if top.bit_length() + bits.bit_length() <= 62:
        key = high.astype(np.int64)
        key <<= bits.bit_length()
        key |= low.astype(np.int64, copy=False)
        return key
    order = np.lexsort((low, high))        # too wide for one number: ranks instead
    h, l = high[order], low[order]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.concatenate([[False], (h[1:] != h[:-1]) | (l[1:] != l[:-1])]))
    return out


def _answers(got: dict[int, bytes], part: np.ndarray, parts: int, columns: int) -> list[np.ndarray]:
    """Columns of a block's answers, in the order of the block's rows (``part``: of each row)."""
    order, edge = _by_part(part, parts)
    out = [np.zeros(len(part), np.int64) for _ in range(columns)]
    for k, blob in got.items():
        for column, values in zip(out, unpack(blob), strict=True):
            column[order[edge[k]: edge[k + 1]]] = values
    return out


def _one_block(blocks: pa.Table, answers: pa.Table, parts: int, n_train: int) -> tuple[Block, dict[int, dict[int, bytes]]]:
    row = blocks.slice(0, 1).to_pylist()[0]
    got: dict[int, dict[int, bytes]] = {WORDS: {}, PAIRS: {}, TRIPLES: {}}
    for kind, part, blob in zip(answers.column("kind").to_pylist(), answers.column("part").to_pylist(),
                                answers.column("answer").to_pylist(), strict=True):
        got[kind][part] = blob
    return Block(row, got[WORDS], parts, n_train), got


def _ask_pairs(parts: int, n_tokens: int, n_train: int):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if blocks.num_rows:
            block, _ = _one_block(blocks, answers, parts, n_train)
            p = block.pairs(parts, n_tokens)
            order, edge = _by_part(p["part"], parts)
            name = blocks.column("block")[0].as_py()
            for part in np.flatnonzero(np.diff(edge)).tolist():
                s = order[edge[part]: edge[part + 1]]
                v = p["v"][s]
                begin = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))      # a context once, with its count
                head = pack(np.diff(v[begin], prepend=0), p["cv"][s][begin], np.diff(np.append(begin, len(v))))
                rows.append((part, name, joined(head, pack(p["w"][s], p["n"][s], p["cw"][s]))))
        columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary()), strict=True)],
                                    names=["part", "of_block", "asked"])
    return run


def _ask_triples(parts: int, n_tokens: int, n_train: int):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if blocks.num_rows:
            block, got = _one_block(blocks, answers, parts, n_train)
            p = block.pairs(parts, n_tokens)
            codes, counts = _answers(got[PAIRS], p["part"], parts, 2)
            t = block.triples(p, counts, parts, n_tokens)
            order, edge = _by_part(t["part"], parts)
            name = blocks.column("block")[0].as_py()
            for part in np.flatnonzero(np.diff(edge)).tolist():
                s = order[edge[part]: edge[part + 1]]
                a, b = t["first"][s], t["second"][s]
                begin = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                c = a[begin]
                rows.append((part, name, pack(np.diff(p["v"][c], prepend=0), p["w"][c], counts[c], np.diff(np.append(begin, len(a)))),
                             pack(p["w"][b], t["n"][s], codes[b])))
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        return pa.Table.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
            names=["part", "of_block", "contexts", "asked"])
    return run


def _answer_triples(group: pa.Table) -> pa.Table:
    """The trie of one part's pairs as contexts, and its answers to every block."""
    part = group.column("part")[0].as_py()
    blocks = group.column("of_block").to_pylist()
    heads, asked = [], []
    for context, blob in zip(group.column("contexts"), group.column("asked"), strict=True):
        u, v, c, times = unpack(context.as_py())
        heads.append((_narrow(np.cumsum(u.astype(np.int64))), _narrow(v), _narrow(c), _narrow(times)))
        asked.append(tuple(_narrow(x) for x in unpack(blob.as_py())))
    lengths = [len(q[0]) for q in asked]
    u, v, c, times = (np.concatenate(x) for x in zip(*heads, strict=True))
    w, n, code = (np.concatenate(x) for x in zip(*asked, strict=True))
    del heads, asked
    # contexts are ranked within the part; a context's count is the same in every message
    head, rank, _ = _distinct(_joint(u, v), np.zeros(len(u), np.int64), runs=True)
    of, x = c[head].astype(np.int64), np.repeat(rank, times)
    del u, v, c, times, rank, head
    first, place, count = _distinct(_joint(x, w), n, runs=True)
    x, w, code = (a[first].astype(np.int64) for a in (x, w, code))          # distinct triples, in order
    seen = np.flatnonzero(count)
    cx = of[x]
    p = (count[seen] + MU * 10.0 ** (code[seen] / -float(STEP))) / (cx[seen] + MU)
    contexts = x[seen]
    begin = seen[np.concatenate([[True], contexts[1:] != contexts[:-1]])] if len(seen) else seen
    trie = Trie(contexts, w[seen], _code(MU / (cx[begin] + MU)), _code(p))
    del seen, contexts, begin, p, count, first
    found, _ = trie.find(x, w)
    answer = np.where(found >= 0, found, np.minimum(_code(MU / (cx + MU)) + code, 65535))[place]
    answers = [pack(a) for a in np.split(answer, np.cumsum(lengths)[:-1])]
    zero = [0] * len(blocks)
    return pa.Table.from_arrays([
        pa.array([part] * len(blocks), pa.int32()), pa.array(blocks, pa.int64()), pa.array([TRIPLES] * len(blocks), pa.int32()),
        pa.array(answers, pa.binary()), pa.array(zero, pa.int64()), pa.array(zero, pa.int64())], schema=_ANSWERED)


def unigram(count: np.ndarray, n_tokens: int, n_types: int) -> np.ndarray:
    """Probability of a token of that training count; 0: all unknown words together."""
    n, v = max(n_tokens, 1), max(n_types, 1)
    return np.where(count > 0, (count - DISCOUNT) / n, DISCOUNT * v / n)


def _code(p: np.ndarray) -> np.ndarray:
    """A probability as steps of 1/4096 decade below 1, in 16 bits."""
    return np.minimum(np.rint(-np.log10(np.maximum(p, 1e-15)) * STEP), 65535).astype(np.int64)


def _answer_pairs(n_tokens: int, n_types: int):
    def run(group: pa.Table) -> pa.Table:
        """The trie of one part's contexts, and its answers to every block."""
        part = group.column("part")[0].as_py()
        blocks = group.column("of_block").to_pylist()
        heads, asked = [], []
        for blob in group.column("asked").to_pylist():
            head, body = halves(blob)
            v, cv, times = (x.astype(np.int64) for x in unpack(head))
            heads.append((np.repeat(_narrow(np.cumsum(v)), times), np.repeat(_narrow(cv), times)))
            asked.append(tuple(_narrow(x) for x in unpack(body)))
        lengths = [len(q[0]) for q in asked]
        v, cv = (np.concatenate(c) for c in zip(*heads, strict=True))
        w, n, cw = (np.concatenate(c) for c in zip(*asked, strict=True))
        del heads, asked
        first, place, count = _distinct(_joint(v, w), n, runs=True)
        v, w, cv, cw = (a[first].astype(np.int64) for a in (v, w, cv, cw))          # distinct pairs, in order
        seen = np.flatnonzero(count)
        p = (count[seen] + MU * unigram(cw[seen], n_tokens, n_types)) / (cv[seen] + MU)
        contexts = v[seen]
        begin = seen[np.concatenate([[True], contexts[1:] != contexts[:-1]])] if len(seen) else seen
        trie = Trie(contexts, w[seen], _code(MU / (cv[begin] + MU)), _code(p))
        pair, context = trie.find(v, w)
        context = np.where(context >= 0, context, _code(MU / (cv + MU)))
        back = np.minimum(context + _code(unigram(cw, n_tokens, n_types)), 65535)
        answer = np.where(pair >= 0, pair, back)[place]
        count = count[place]                                # training count of every asked pair
        ends = np.cumsum(lengths)[:-1]
        answers = [pack(a, c) for a, c in zip(np.split(answer, ends), np.split(count, ends), strict=True)]
        zero = [0] * len(blocks)
        return pa.Table.from_arrays([
            pa.array([part] * len(blocks), pa.int32()), pa.array(blocks, pa.int64()), pa.array([PAIRS] * len(blocks), pa.int32()),
            pa.array(answers, pa.binary()), pa.array(zero, pa.int64()), pa.array(zero, pa.int64())], schema=_ANSWERED)
    return run


# ---- scores --------------------------------------------------------------------------------------------------------

SCORED = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
          "pair_score double")
_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
                     ("pair_score", pa.float64())])


def _scores(parts: int, n_tokens: int, n_types: int, n_train: int):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return _SCORED.empty_table()
        block, got = _one_block(blocks, answers, parts, n_train)
        p = block.pairs(parts, n_tokens)
        codes, counts = _answers(got[PAIRS], p["part"], parts, 2)
        t = block.triples(p, counts, parts, n_tokens)
        code = codes[p["place"]]
        code3 = code.copy()
        later = np.flatnonzero(t["place"] >= 0)
        code3[later] = _answers(got[TRIPLES], t["part"], parts, 1)[0][t["place"][later]]
        base = np.log10((block.times + 0.1) / (n_tokens + 0.1 * (n_types + 1)))
        return pa.Table.from_arrays([
            pa.array(block.doc_ids, pa.int64()), pa.array(block.held), pa.array(block.sizes),
            pa.array(np.add.reduceat((block.times > 0).astype(np.int64), block.begins)),
            pa.array(np.full(len(block.held), n_tokens, np.int64)), pa.array(np.add.reduceat(base, block.begins)),
            pa.array(np.add.reduceat(code3, block.begins) / -float(STEP)),
            pa.array(np.add.reduceat(code, block.begins) / -float(STEP))], schema=_SCORED)
    return run


def score(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> one row of scores per row."""
    spark = docs.sparkSession
    stage = Staging(spark, "trie")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = input_bytes(texts)
    parts = max(spark.sparkContext.defaultParallelism, -(-size // MODEL_PART_BYTES) if size < 1 << 60 else 0)
    blocks = bucketed(texts.mapInArrow(_make_blocks, BLOCK), "block", stage.root,
                      max(spark.sparkContext.defaultParallelism, shuffle_partitions(spark)))
    words = stage.write(blocks.select("block", "words").mapInArrow(_ask_words(parts), ASKED)
                        .groupBy("part").applyInArrow(_answer_words(parts), ANSWERED), "words")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT == 0, F.lit(True))
    n_train = int(texts.filter(~held).count())
    sums = words.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_types"), F.lit(0))).first()
    n_tokens, n_types = int(sums[0]) + n_train, int(sums[1]) + (n_train > 0)
    asked = (blocks.groupBy("block").cogroup(words.groupBy("of_block"))
             .applyInArrow(_ask_pairs(parts, n_tokens, n_train), ASKED))
    pairs = stage.write(asked.groupBy("part").applyInArrow(_answer_pairs(n_tokens, n_types), ANSWERED), "pairs")
    known = words.union(pairs)
    asked3 = (blocks.groupBy("block").cogroup(known.groupBy("of_block"))
              .applyInArrow(_ask_triples(parts, n_tokens, n_train), "part int, of_block long, contexts binary, asked binary"))
    # written, so that the shuffle of the questions can go before the answers move
    triples = stage.write(asked3.groupBy("part").applyInArrow(_answer_triples, ANSWERED), "triples")
    return (blocks.groupBy("block").cogroup(known.union(triples).groupBy("of_block"))
            .applyInArrow(_scores(parts, n_tokens, n_types, n_train), SCORED))
