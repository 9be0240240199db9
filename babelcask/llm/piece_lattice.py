"""SentencePiece encoding and decoding as a relational lattice.

The piece table of a given model file is a DataFrame (piece, id, score).  The
distinct units of all texts (below) are exploded into their substrings of up
to the longest piece's length, the substrings are equi-joined to the piece
table, the matches (edges of the lattice) are grouped by unit, and a Viterbi
fold with Spark's ``aggregate`` keeps the segmentation of the largest score sum
(ties: the longer last piece).  A character without a piece of its own is a
fallback edge of score ``lowest score - 10`` and becomes its UTF-8 byte pieces.
That is the segmentation the public library makes of the same pieces and
scores read as a unigram model; see the README for a model file whose own
rule is byte-pair merging.

Text is handled as the model file says: blanks become U+2581, one is put
before a non-empty text.  Where two neighbouring bytes are neighbours in no
piece, no piece can span them, so a text's best segmentation is that of its
units, cut at all such places (with the usual model files: words with the blank
before them, runs of punctuation, single digits, single line breaks).

Scale: tasks cut texts into blocks, name each distinct unit of a block once,
and keep the texts as compressed unit numbers in a table bucketed by block, so
the texts are not moved again.  Blocks send their units to parts by hash, one
compressed message per block and part, so a unit found everywhere is one entry
per block.  A part's distinct units are written in a table bucketed by part;
the lattice runs once per distinct unit and groups its edges inside a part, without
a shuffle.  The parts answer the blocks in the order asked.  The piece table
(at most ``MAX_PIECES`` rows, checked) is broadcast.

A long unbroken unit is exploded by windows of ``WINDOW`` characters that
overlap by the longest piece, and folded with the sums of the last positions
only, so its cost is linear in its length.

Defined cases: a null text encodes as an empty list (``text_sha256`` of the
empty text), as does an empty one; null ids and repeated rows give their rows;
no rows give no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from babelcask.llm import tokens as T
from babelcask.llm.numpack import halves, joined, pack, unpack
from babelcask.llm.work import Staging, bucketed, release_memory, releasing
from babelcask.session import shuffle_partitions

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK, NO_PIECE = "\u2581", "\uffff"
MAX_PIECES = 1_000_000
BLOCK_BYTES = 4_000_000
#: Distinct units per part, about: one task holds the edges of one part.
PART_UNITS = 25_000
PART_BYTES = 1_000_000
#: Piece ids that are gathered or spelled at a time.
PART_IDS = 200_000
#: Positions per inner fold; the outer fold keeps one array per segment.
SEGMENT = 256
#: Characters of a unit that travel with each of their positions.
WINDOW = 64
#: Substrings this long and longer are made where some piece begins with their first so many characters.
PREFIX = 4


# ---- piece table ------------------------------------------------------------------------------------

class Pieces:
    """Pieces of a model file: normal ones with scores, and the 256 byte pieces."""

    def __init__(self, path: str = MODEL):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        if n > MAX_PIECES:
            raise ValueError(f"{n} pieces: more than are handed to every task")
        self.strings = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
        self.rows = [(self.strings[i], i, float(model.get_score(i))) for i in range(n) if not special[i]]
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if len(set(self.byte_ids)) != 256:
            raise ValueError("the model has no byte pieces")
        self.longest = max(len(p) for p, _, _ in self.rows)
        self.fallback = min(s for _, _, s in self.rows) - 10.0
        if any(NO_PIECE in p for p, _, _ in self.rows):
            raise ValueError("a piece holds the character that stands for none")

    def neighbours(self) -> np.ndarray:
        """256 x 256, by first and second byte: whether the two follow each other in some piece."""
        out = np.zeros((256, 256), bool)
        for p, _, _ in self.rows:
            said = np.frombuffer(p.replace(BLANK, " ").encode(), np.uint8)
            out[said[:-1], said[1:]] = True
        return out

    def spelling(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all pieces, one after the other, and the offsets; blanks as spaces, byte pieces as their byte."""
        said = [s.replace(BLANK, " ").encode() for s in self.strings]
        for b, i in enumerate(self.byte_ids):
            said[i] = bytes([b])
        return np.frombuffer(b"".join(said), np.uint8), np.cumsum([0, *map(len, said)])


# ---- texts to blocks of unit numbers (numpy) ----------------------------------------------------------

def _padded(column: pa.Array) -> pa.Array:
    """Texts with one blank before a non-empty one."""
    text = column.cast(pa.large_string()).fill_null("")
    return pc.if_else(pc.equal(pc.binary_length(text), 0), text, pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in (" ", text, ""))))


def unit_starts(data: np.ndarray, texts: np.ndarray, neighbours: np.ndarray) -> np.ndarray:
    """Byte offsets where the units of (padded) texts begin; a unit ends where the next one begins."""
    n = len(data)
    start = np.zeros(n + 1, bool)
    start[1:n] = ~neighbours[data[:-1], data[1:]] & ((data[1:] & 0xC0) != 0x80)     # never inside a character
    start[texts] = True
    return np.flatnonzero(start[:n])


def _unit_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the units between the offsets ``at`` (first 0, last the end); every byte counts, blanks too."""
    if len(at) < 2:
        return np.zeros(0, np.uint64)
    place = np.arange(len(data), dtype=np.int32) - np.repeat(at[:-1].astype(np.int32), np.diff(at))
    value = T.powers(int(place.max()) + 1)[place]
    value *= T._BYTE_VALUE[data]
    return T.mix(np.add.reduceat(value, at[:-1]))


def _blocks_of(batch: pa.RecordBatch, neighbours: np.ndarray) -> Iterator[tuple[int, int, list[bytes], np.ndarray, np.ndarray, list[str]]]:
    """(first, last, distinct units by falling count, unit numbers, units per text, sha256 of each text)."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64)
    all_texts = np.concatenate([[0], np.cumsum(sizes)])
    i, n = 0, len(all_texts) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(all_texts, all_texts[i] + BLOCK_BYTES, "right")) - 1))
        data, texts = T.raw_bytes(_padded(batch.column("text").slice(i, j - i)))
        hashes, counts, starts = [], [], []
        k = 0
        while k < j - i:      # a part at a time: byte-wise work needs some 30 bytes a byte
            m = min(j - i, max(k + 1, int(np.searchsorted(texts, texts[k] + PART_BYTES, "right")) - 1))
            part, edge = data[texts[k]: texts[m]], texts[k: m + 1] - texts[k]
            at = unit_starts(part, edge, neighbours)
            hashes.append(_unit_hashes(part, np.append(at, len(part))))
            counts.append(np.diff(np.searchsorted(at, edge)))
            starts.append(at + texts[k])
            k = m
        hashes, starts = np.concatenate(hashes), np.append(np.concatenate(starts), len(data))
        _, first, number, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        first = first[order]
        body = memoryview(data)
        units = [bytes(body[a:b]) for a, b in zip(starts[first].tolist(), starts[first + 1].tolist(), strict=True)]
        digests = [hashlib.sha256(body[a + (b > a): b]).hexdigest()
                   for a, b in zip(texts[:-1].tolist(), texts[1:].tolist(), strict=True)]
        yield i, j, units, rank[number], np.concatenate(counts), digests
        i = j


BLOCK = "block long, doc_ids array<long>, digests array<string>, per_text binary, numbers binary, n_names int, names binary"


def _pack_names(units: list[bytes]) -> bytes:
    return joined(pack(np.array([len(u) for u in units], np.int64)), pa.compress(b"".join(units), codec="zstd", asbytes=True))


def _unpack_names(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets)."""
    head, body = halves(blob)
    at = np.concatenate([[0], np.cumsum(unpack(head)[0].astype(np.int64))])
    return np.frombuffer(pa.decompress(body, int(at[-1]), codec="zstd", asbytes=True), np.uint8), at


def _name_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = []
    for lo in range(0, len(at) - 1, 200_000):
        part = at[lo: lo + 200_001]
        out.append(_unit_hashes(data[part[0]: part[-1]], part - part[0]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _make_blocks(neighbours: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, units, numbers, per_text, digests in _blocks_of(batch, neighbours):
                yield pa.RecordBatch.from_arrays([
                    pa.array([uuid.uuid4().int >> 65], pa.int64()),
                    pa.array([batch.column("doc_id").slice(first, last - first).to_pylist()], pa.list_(pa.int64())),
                    pa.array([digests], pa.list_(pa.string())),
                    pa.array([pack(per_text)], pa.binary()), pa.array([pack(numbers)], pa.binary()),
                    pa.array([len(units)], pa.int32()), pa.array([_pack_names(units)], pa.binary())],
                    names=["block", "doc_ids", "digests", "per_text", "numbers", "n_names", "names"])
    return run


ASKED = "part int, of_block long, asked binary"


def _ask(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("names").to_pylist(), strict=True):
                data, at = _unpack_names(blob)
                part = (_name_hashes(data, at) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                edge = np.searchsorted(part[order], np.arange(parts + 1))
                body, rows = data.tobytes(), []
                for p in np.flatnonzero(np.diff(edge)).tolist():
                    mine = order[edge[p]: edge[p + 1]]
                    rows.append((p, block, _pack_names([body[at[i]: at[i + 1]] for i in mine])))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)],
                        names=["part", "of_block", "asked"])
    return run


def _distinct_names(messages: list[bytes]) -> tuple[list[str], list[np.ndarray]]:
    """Distinct units of one part in the order of their hashes, and each message's units as numbers of them."""
    unpacked = [_unpack_names(m) for m in messages]
    hashes = [_name_hashes(data, at) for data, at in unpacked]
    _, first, number = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    ends = np.cumsum([len(h) for h in hashes])
    units = []
    for i in first.tolist():
        k = int(np.searchsorted(ends, i, "right"))
        data, at = unpacked[k]
        j = i - (int(ends[k - 1]) if k else 0)
        units.append(data[at[j]: at[j + 1]].tobytes().decode())
    return units, np.split(number, ends[:-1])


def _units_of(group: pa.Table) -> pa.Table:
    units, _ = _distinct_names(group.column("asked").to_pylist())
    release_memory()        # the lattice that reads the units runs in the JVM, beside idle workers
    return pa.Table.from_arrays(
        [pa.array([group.column("part")[0].as_py()] * len(units), pa.int32()), pa.array(np.arange(len(units), dtype=np.int32)),
         pa.array(units, pa.string())], names=["of_part", "number", "unit"])


ANSWERED = "of_block long, part int, answer binary"


def _answer(byte_ids: list[int]):
    def run(asked: pa.Table, paths: pa.Table) -> pa.Table:
        """Every block's units of one part as (number of pieces, pieces), in the order asked."""
        if not asked.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.binary())],
                                        names=["of_block", "part", "answer"])
        _, numbers = _distinct_names(asked.column("asked").to_pylist())
        order = np.argsort(paths.column("number").to_numpy())
        lists = paths.column("path").combine_chunks()
        flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
        flat, sizes = _byte_fallback(flat, sizes, byte_ids)
        start, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
        answers = [joined(pack(sizes[n]), pack(_gather(flat, start[n], sizes[n]))) for n in numbers]
        return pa.Table.from_arrays(
            [asked.column("of_block"), asked.column("part"), pa.array(answers, pa.binary())], names=["of_block", "part", "answer"])
    return run


# ---- lattice (Spark) ------------------------------------------------------------------------------------

def segment(units: DataFrame, pieces: Pieces, key: list[str]) -> DataFrame:
    """``units(*key, unit)``, one row per key -> (*key, path): piece ids, -1 - code point for a character without a piece.

    Rows that are placed by a part of the key are grouped without an exchange.
    """
    table = F.broadcast(units.sparkSession.createDataFrame(pieces.rows, "piece string, id int, score double"))
    # a text's own U+2581 is not a blank: it becomes a character that no piece holds
    spelled = (units.withColumn("said", F.translate("unit", BLANK + " ", NO_PIECE + BLANK))
               .withColumn("n", F.char_length("said")))
    # a position carries the window it lies in, not its unit: the work is linear in a unit's length
    spelled = spelled.select(*key, "unit", "said", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(WINDOW))).alias("w"))
    reaching = WINDOW + max(pieces.longest, PREFIX) - 1
    windows = spelled.select(
        *key, F.expr(f"substring(unit, w + 1, {WINDOW})").alias("unit"), F.expr(f"substring(said, w + 1, {reaching})").alias("said"),
        (F.col("n") - F.col("w")).alias("n"), "w", F.explode(F.sequence(F.lit(1), F.least(F.lit(WINDOW), F.col("n") - F.col("w")))).alias("s"))
    starts = windows.select(*key, "unit", "said", "n", "w", "s")
    # the longest piece that begins with the next characters bounds the substrings from here
    reach = F.broadcast(table.groupBy(F.substring("piece", 1, PREFIX).alias("lead")).agg(F.max(F.char_length("piece")).alias("most"))
                        .filter(F.col("most") >= PREFIX))
    starts = (starts.withColumn("lead", F.substring("said", F.col("s"), F.lit(PREFIX))).join(reach, "lead", "left")
              .withColumn("most", F.coalesce("most", F.lit(PREFIX - 1))))
    spans = starts.select(*key, "unit", "said", "w", "s", F.explode(F.sequence(
        F.lit(1), F.least("most", F.col("n") - F.col("s") + 1))).alias("l"))
    spans = spans.select(*key, F.substring("unit", F.col("s"), F.lit(1)).alias("first"), (F.col("w") + F.col("s")).alias("s"), "l",
                         F.substring("said", F.col("s"), F.col("l")).alias("piece"))
    edges = (spans.join(table, "piece", "left").filter("id IS NOT NULL OR l = 1")
             .select(*key, F.struct(
                 (F.col("s") + F.col("l")).alias("e"), F.col("l"),
                 F.coalesce("id", -1 - F.ascii("first")).alias("id"),
                 F.coalesce("score", F.lit(pieces.fallback)).alias("score")).alias("edge")))
    lattice = edges.groupBy(*key).agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    return lattice.select(*key, _viterbi(pieces.longest).alias("path"))


def _viterbi(longest: int):
    """Fold over the edges sorted by end; ``sums`` holds the best sums of the last positions, at least ``longest``."""
    back = "array<array<struct<l:int,id:int>>>"
    segment = max(SEGMENT, longest)
    zero = F.struct(
        F.array(F.lit(0.0)).alias("sums"),
        F.lit(2).alias("e"),                                          # the end that is being collected
        F.struct(F.lit(float("-inf")).alias("sum"), F.lit(0).alias("l"), F.lit(0).alias("id")).alias("best"),
        F.array().cast(back).alias("done"), F.array().cast("array<struct<l:int,id:int>>").alias("open"))

    def closed(s):
        """(done, open) after the current end: its best edge is settled."""
        edge = F.struct(s["best"]["l"].alias("l"), s["best"]["id"].alias("id"))
        full = F.size(s["open"]) == segment
        return (F.when(full, F.array_append(s["done"], s["open"])).otherwise(s["done"]),
                F.when(full, F.array(edge)).otherwise(F.array_append(s["open"], edge)))

    def step(s, x):
        same = x["e"] == s["e"]
        done, opened = closed(s)
        # every position has an edge, so the next end is the next position: its sums begin with the best one
        before = F.when(same, F.element_at(s["sums"], -x["l"])).when(x["l"] == 1, s["best"]["sum"]).otherwise(
            F.element_at(s["sums"], 1 - x["l"]))
        older = F.when(F.size(s["open"]) == segment, F.slice(s["sums"], -longest, longest)).otherwise(s["sums"])
        mine = F.struct((before + x["score"]).alias("sum"), x["l"].alias("l"), x["id"].alias("id"))
        return F.struct(
            F.when(same, s["sums"]).otherwise(F.array_append(older, s["best"]["sum"])).alias("sums"), x["e"].alias("e"),
            F.when(same, F.greatest(s["best"], mine)).otherwise(mine).alias("best"),
            F.when(same, s["done"]).otherwise(done).alias("done"),
            F.when(same, s["open"]).otherwise(opened).alias("open"))

    def path(s):
        done, opened = closed(s)
        return F.array_append(done, opened)

    def walk(segments):
        """Back from the last position: take an edge where one is due."""
        start = F.struct(F.lit(0).alias("skip"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(
            F.reverse(segments), start,
            lambda s, part: F.aggregate(
                F.reverse(part), s,
                lambda t, x: F.when(t["skip"] > 0, F.struct((t["skip"] - 1).alias("skip"), t["out"].alias("out"))).otherwise(
                    F.struct((x["l"] - 1).alias("skip"), F.array_append(t["out"], x["id"]).alias("out")))),
            lambda s: F.reverse(s["out"]))

    return walk(F.aggregate("edges", zero, step, path))


# ---- back to texts (numpy) --------------------------------------------------------------------------------

ENCODED = "doc_id long, ids array<int>, text_sha256 string, decoded_sha256 string"
_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("text_sha256", pa.string()),
                      ("decoded_sha256", pa.string())])


def _byte_fallback(flat: np.ndarray, sizes: np.ndarray, byte_ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids with every character code (-1 - code point) replaced by the pieces of its UTF-8 bytes."""
    odd = np.flatnonzero(flat < 0)
    if not len(odd):
        return flat, sizes
    said = [[byte_ids[b] for b in chr(-1 - int(flat[i])).encode()] for i in odd]
    width = np.ones(len(flat), np.int64)
    width[odd] = [len(x) for x in said]
    out = np.repeat(flat, width)
    at = (np.cumsum(width) - width)[odd]
    for start, ids in zip(at, said, strict=True):
        out[start: start + len(ids)] = ids
    ends = np.concatenate([[0], np.cumsum(width)])
    edge = np.concatenate([[0], np.cumsum(sizes)])
    return out, np.diff(ends[edge])


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start: start + size] of every range, one after the other."""
    total = int(size.sum())
    kind = np.int32 if max(total, len(flat)) < 2**31 else np.int64
    place = np.repeat((start - (np.cumsum(size, dtype=np.int64) - size)).astype(kind), size)
    place += np.arange(total, dtype=kind)
    return flat[place]


def _spelled(ids: np.ndarray, edge: np.ndarray, spelling: tuple[np.ndarray, np.ndarray]) -> Iterator[bytes]:
    """Texts of runs of piece ids (``edge``: their offsets), without the blank put before a text, some at a time."""
    data, at = spelling
    i, n = 0, len(edge) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(edge, edge[i] + PART_IDS, "right")) - 1))
        mine = ids[edge[i]: edge[j]]
        if j == i + 1 and len(mine) > PART_IDS:      # one long text: its pieces in parts
            runs = (mine[k: k + PART_IDS] for k in range(0, len(mine), PART_IDS))
            body = b"".join(_gather(data, at[r], at[r + 1] - at[r]).tobytes() for r in runs)
            yield body[1:]
        else:
            width = at[mine + 1] - at[mine]
            body = _gather(data, at[mine], width).tobytes()
            ends = np.concatenate([[0], np.cumsum(width)])[edge[i: j + 1] - edge[i]]
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                yield body[a + (b > a): b]
        i = j


def _assemble(parts: int, spelling: tuple[np.ndarray, np.ndarray]):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return _ENCODED.empty_table()
        names = blocks.column("names")[0].as_py()
        part = (_name_hashes(*_unpack_names(names)) % np.uint64(parts)).astype(np.int32)
        del names
        sizes, start = np.zeros(len(part), np.int32), np.zeros(len(part), np.int64)
        flat, at = [np.zeros(0, np.int32)], 0
        for p, blob in zip(answers.column("part").to_pylist(), answers.column("answer"), strict=True):
            head, body = halves(blob.as_py())      # a part's answer at a time, kept as 4-byte ids
            size, ids = unpack(head)[0].astype(np.int32), unpack(body)[0].astype(np.int32)
            mine = np.flatnonzero(part == p)
            sizes[mine], start[mine] = size, at + np.cumsum(size, dtype=np.int64) - size
            flat.append(ids)
            at += len(ids)
        flat = np.concatenate(flat)
        numbers = unpack(blocks.column("numbers")[0].as_py())[0].astype(np.int32)
        per_unit = sizes[numbers]
        ids = np.empty(int(per_unit.sum(dtype=np.int64)), np.int32)
        ends = np.concatenate([[0], np.cumsum(per_unit, dtype=np.int64)])
        for lo in range(0, len(numbers), PART_IDS):
            some = slice(lo, lo + PART_IDS)
            ids[ends[lo]: ends[min(lo + PART_IDS, len(numbers))]] = _gather(flat, start[numbers[some]], per_unit[some])
        per_text = np.concatenate([[0], np.cumsum(unpack(blocks.column("per_text")[0].as_py())[0].astype(np.int64))])
        edge = ends[per_text]
        del flat, numbers, per_unit, ends
        back = [hashlib.sha256(t).hexdigest() for t in _spelled(ids, edge, spelling)]
        return pa.Table.from_arrays([
            blocks.column("doc_ids").combine_chunks().flatten(),
            pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids)),
            blocks.column("digests").combine_chunks().flatten(), pa.array(back, pa.string())], schema=_ENCODED)
    return run


def encode(docs: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> (doc_id, ids, text_sha256, decoded_sha256), one row per row of ``docs``.

    The second digest is of what the ids decode to; it is taken where the ids are put together.
    """
    spark = docs.sparkSession
    pieces = pieces or Pieces()
    stage = Staging(spark, "pieces")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    least = max(spark.sparkContext.defaultParallelism, shuffle_partitions(spark))
    blocks = bucketed(texts.mapInArrow(releasing(_make_blocks(pieces.neighbours())), BLOCK), "block", stage.root, least)
    # every block's distinct units counted once bound the distinct units from above
    parts = max(least, -(-int(blocks.agg(F.sum("n_names")).first()[0] or 0) // (4 * PART_UNITS)))
    asked = blocks.select("block", "names").mapInArrow(releasing(_ask(parts)), ASKED)
    units = bucketed(asked.groupBy("part").applyInArrow(_units_of, "of_part int, number int, unit string"),
                     "of_part", stage.root, parts)
    paths = bucketed(segment(units, pieces, ["of_part", "number"]), "of_part", stage.root, parts)
    answers = asked.groupBy("part").cogroup(paths.groupBy("of_part")).applyInArrow(_answer(pieces.byte_ids), ANSWERED)
    return (blocks.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(_assemble(parts, pieces.spelling()), ENCODED))


def _decode(spelling):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("ids")
            step = max(1, int(2_000_000 * len(column) / max(1, len(column.flatten()))))
            for lo in range(0, len(column), step):
                lists = column.slice(lo, step)
                edge = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
                text = [t.decode("utf-8", "replace") for t in _spelled(lists.flatten().to_numpy(), edge, spelling.value)]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(lo, step) for c in batch.schema.names if c != "ids"],
                     pa.array(text, pa.string())], names=[*[c for c in batch.schema.names if c != "ids"], "text"])
    return run


def decode(encoded: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """Rows with ``ids`` -> the same rows with ``text`` instead; the blank put before a text is taken off."""
    pieces = pieces or Pieces()
    spelling = encoded.sparkSession.sparkContext.broadcast(pieces.spelling())
    kept = [f for f in encoded.schema if f.name != "ids"]
    schema = T_.StructType([*kept, T_.StructField("text", T_.StringType())])
    return encoded.mapInArrow(_decode(spelling), schema)


def round_trip(docs: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """(doc_id, n_pieces, ids_hash, text_sha256, round_trip): whether the ids decode to the text."""
    return encode(docs, pieces).select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "text_sha256",
        (F.col("decoded_sha256") == F.col("text_sha256")).alias("round_trip"))
