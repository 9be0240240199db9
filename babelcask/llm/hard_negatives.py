"""Hard negatives by coordinate pruning over length buckets.

Rows are integer vectors; a score is the inner product of a row with an
anchor.  Rows are cut into blocks: by label group, then by length bucket (each
bucket's lengths are within 10 %), then by hash into blocks of about
``BLOCK_ROWS`` rows, so neither a frequent label nor one length fills a task.
A block holds, per coordinate, the list of its rows sorted by the normalised
value of that coordinate.  For an anchor and a lowest wanted score:

* no row of a block can reach it if it exceeds anchor length times the
  block's largest length: the block is skipped;
* otherwise the wanted cosine is at least ``lowest / (lengths)``, and a row
  whose angle with the anchor is that small has each coordinate within the
  angle, too: the anchor's ``FOCUS`` largest coordinates each give a feasible
  range of values, a run of the sorted list;
* the runs' rows are intersected and the candidates' exact scores computed.
  Where no coordinate excludes a row, all of the block's rows are candidates.

A job deals every block to every block of anchors that may need it (the
stated query set against all rows, in blocks), one pair a task group.  The
lowest score comes from a first job over one block only: the k-th best there
is a lower bound of the k-th best of all.  Positives (same label) are searched
in the anchor's label group; negatives in all blocks, with an upper end per
positive.  Ties take part down to the last place, so results are exact.

Angles are widened by 1e-9, so rounding excludes nothing; scores are exact
integers (in doubles while below 2**53, else in Python integers; a score past
64 bits is an error).

Defined cases: rows with a null id, label or vector or a null or non-finite
component take no part; equal ids are one row, the least (label, vector); a
shorter vector counts as padded with zeros; zero vectors score 0; anchors
without positives or negatives give no rows; empty tables give none; other
columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from babelcask.llm.work import Staging

BLOCK_ROWS = 8192
ANCHOR_ROWS = 2048
LABEL_GROUPS = 16
LENGTH_BUCKETS = 64
FOCUS = 4
#: Rows scored at once in a task (anchors of a slice times a block's rows).
SLICE = 64
FOUND = "anchor_id long, request long, score long, vec_id long"
_FOUND = pa.schema([("anchor_id", pa.int64()), ("request", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64())])


def vectors(embeddings: DataFrame, label: Column) -> DataFrame:
    """(vec_id, label, v, length) of the rows that take part; ``label`` is an expression over (vec_id, label)."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    usable = ~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = (embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
            .dropna().filter(usable)
            .select("vec_id", label.cast("long").alias("label"), F.transform("x", lambda e: F.floor(256 * e).cast("long")).alias("v")))
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    square = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    return one.withColumn("length", F.sqrt(square))


def blocked(rows: DataFrame, stage: Staging) -> tuple[DataFrame, list[tuple[int, int, int, int]]]:
    """Rows with their ``grp`` and ``block``, and the blocks as (group, first block, blocks, rows) per length bucket.

    The list has at most ``LABEL_GROUPS * LENGTH_BUCKETS`` entries.
    """
    longest = rows.agg(F.max("length")).first()[0] or 0.0
    step = math.log(1 / 0.9)
    bucket = F.when(F.col("length") > 0, F.least(
        F.lit(LENGTH_BUCKETS - 1), F.floor(F.log(F.lit(float(longest)) / F.col("length")) / step))).otherwise(LENGTH_BUCKETS - 1)
    placed = rows.withColumn("grp", F.pmod(F.xxhash64("label"), F.lit(LABEL_GROUPS)).cast("int")).withColumn("bucket", bucket.cast("int"))
    sizes = placed.groupBy("grp", "bucket").agg(F.count(F.lit(1)).alias("n")).orderBy("grp", "bucket").collect()
    spans, at = [], 0
    for r in sizes:
        parts = -(-r["n"] // BLOCK_ROWS)
        spans.append((r["grp"], r["bucket"], at, parts, r["n"]))
        at += parts
    plan = rows.sparkSession.createDataFrame(spans, "grp int, bucket int, start long, parts long, total long")
    block = F.col("start") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    dealt = stage.write(placed.join(F.broadcast(plan), ["grp", "bucket"])
                        .select("vec_id", "label", "v", "length", "grp", block.alias("block")), "rows")
    return dealt, [(g, start, parts, n) for g, _, start, parts, n in spans]


class _Block:
    """Rows of a block, by id, with their sorted coordinate lists."""

    def __init__(self, table: pa.Table, width: int):
        order = np.argsort(table["vec_id"].to_numpy())
        self.ids = table["vec_id"].to_numpy()[order]
        self.labels = table["label"].to_numpy()[order]
        self.rows = _matrix(table["v"], width)[order]
        lengths = table["length"].to_numpy()[order]
        self.longest = float(lengths.max())
        self.unit = (self.rows / np.where(lengths > 0, lengths, 1)[:, None]).T.copy()
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """(values in order, their row numbers) of coordinate ``f``."""
        if f not in self.lists:
            order = np.argsort(self.unit[f], kind="stable")
            self.lists[f] = self.unit[f][order], order
        return self.lists[f]

    def candidates(self, anchor: np.ndarray, length: float, lowest: float) -> np.ndarray | slice | None:
        """Row numbers that may score ``lowest`` or more: all (a slice), some, or none."""
        if lowest <= 0:
            return slice(None)
        reach = length * self.longest
        if lowest > reach * (1 + 1e-9):
            return None
        wide = math.acos(min(1.0, lowest / reach)) + 1e-9
        unit = anchor / length
        focus = np.argsort(-np.abs(unit))[:FOCUS]
        angle = np.arccos(np.clip(unit[focus], -1, 1))
        low = np.cos(np.minimum(np.pi, angle + wide)) - 1e-12
        high = np.cos(np.maximum(0.0, angle - wide)) + 1e-12
        runs = []
        for f, a, b in zip(focus, low, high, strict=True):
            values, _ = self.sorted_list(f)
            runs.append((int(np.searchsorted(values, a)), int(np.searchsorted(values, b, "right"))))
        k = min(range(len(runs)), key=lambda i: runs[i][1] - runs[i][0])
        first, last = runs[k]
        if last - first == len(self.ids):
            return slice(None)
        found = self.sorted_list(focus[k])[1][first:last]
        for i, f in enumerate(focus):
            if i != k and runs[i][1] - runs[i][0] < len(self.ids):
                value = self.unit[f][found]
                found = found[(value >= low[i]) & (value <= high[i])]
        return np.sort(found)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows, padded with zeros; doubles if every product sum is below 2**53, else Python integers."""
    column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy()
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` first by falling score, then by id (``ids`` rise)."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
        return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
    return np.lexsort((ids, -scores))


def _searcher(same_label: bool, k: int):
    def search(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return _FOUND.empty_table()
        widest = lambda t: int(np.diff(t["v"].combine_chunks().offsets.to_numpy()).max())
        width = max(1, widest(anchors), widest(rows))
        block = _Block(rows, width)
        asked = _matrix(anchors["v"], width)
        bound = float(np.abs(asked).max(initial=0)) * float(np.abs(block.rows).max(initial=0)) * width
        exact = np.float64 if bound < 2**53 else object
        matrix, asked = block.rows.astype(exact), asked.astype(exact)
        ids, labels, lengths = (anchors[c].to_numpy() for c in ("vec_id", "label", "length"))
        requests = anchors["requests"].to_pylist()
        out: list[tuple[np.ndarray, ...]] = []

        def answer(a: int, at, scores: np.ndarray) -> None:
            mine = block.labels[at] == labels[a]
            free = (mine & (block.ids[at] != ids[a])) if same_label else ~mine
            at = np.arange(len(block.ids))[at][free]
            scores = scores[free].astype(np.int64)
            for r in requests[a]:
                within = np.flatnonzero((scores >= r["low"]) & (scores <= r["high"]))
                best = within[_best(scores[within], block.ids[at[within]], k)]
                out.append((np.full(len(best), ids[a]), np.full(len(best), r["request"]), scores[best], block.ids[at[best]]))

        whole = []
        for a in range(len(ids)):
            at = block.candidates(asked[a].astype(np.float64), lengths[a], min(r["low"] for r in requests[a]))
            if isinstance(at, slice):
                whole.append(a)
            elif at is not None and len(at):
                answer(a, at, matrix[at] @ asked[a])
        for i in range(0, len(whole), SLICE):
            scores = asked[whole[i: i + SLICE]] @ matrix.T
            for a, row in zip(whole[i: i + SLICE], scores, strict=True):
                answer(a, slice(None), row)
        if not out:
            return _FOUND.empty_table()
        return pa.table([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], schema=_FOUND)
    return search


def _search(anchors: DataFrame, rows: DataFrame, same_label: bool, k: int) -> DataFrame:
    """``anchors(block, part, vec_id, label, v, length, requests)`` against ``rows(block, part, ...)`` -> ``FOUND``."""
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return _searcher(same_label, k)(left, right)
    anchors = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])     # both sides come from one table
    return anchors.groupBy("block", "part").cogroup(rows.groupBy("block", "part")).applyInArrow(run, FOUND)


def _first(found: DataFrame, k: int, out: str = "rank") -> DataFrame:
    order = Window.partitionBy("anchor_id", "request").orderBy(F.desc("score"), "vec_id")
    return found.withColumn(out, F.row_number().over(order)).filter(F.col(out) <= k)


def _floors(best: DataFrame, k: int) -> DataFrame:
    """(anchor_id, request, floor): the k-th score where the first block had as many."""
    return best.filter(F.col("rank") == k).select("anchor_id", "request", F.col("score").alias("floor"))


def hard_negatives(embeddings: DataFrame, anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 3,
                   band: tuple[int, int] = (50, 95)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor``: condition over ``vec_id``; ``band``: percent of the positive's
    score between which a negative's score lies, both ends included.
    """
    stage = Staging(embeddings.sparkSession, "hard_negatives")
    rows, spans = blocked(vectors(embeddings, F.col("label") if label is None else label), stage)
    if not spans:
        return _empty(embeddings.sparkSession)
    anchors = rows.filter(anchor).drop("block")
    parts = {r["grp"]: -(-r["count"] // ANCHOR_ROWS) for r in anchors.groupBy("grp").count().collect()}
    fullest: dict[int, tuple[int, int]] = {}      # per group: (rows a block, first block) of its fullest bucket
    ends: dict[int, tuple[int, int]] = {}
    for g, start, n, total in spans:
        fullest[g] = max(fullest.get(g, (0, 0)), (-(-total // n), start))
        ends[g] = (min(ends.get(g, (start, 0))[0], start), start + n - 1)
    groups = [(g, parts[g], *ends[g], fullest[g][1]) for g in sorted(ends) if g in parts]
    if not groups:
        return _empty(embeddings.sparkSession)
    plan = F.broadcast(embeddings.sparkSession.createDataFrame(
        groups, "grp int, parts long, first_block long, last_block long, seed long"))
    part = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("parts"))
    columns = ["vec_id", "label", "v", "length"]

    def positive_pass(low: DataFrame | None, seed: bool) -> DataFrame:
        own = F.col("block") == F.col("seed")
        mine = rows.join(plan, "grp").filter(own if seed else ~own)
        mine = mine.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), *columns)
        asking = anchors.join(plan, "grp")
        floor = F.lit(-(2**62))
        if low is not None:
            asking = asking.join(low.select(F.col("anchor_id").alias("vec_id"), "floor"), "vec_id", "left")
            floor = F.coalesce("floor", floor)
        request = F.array(F.struct(F.lit(0).cast("long").alias("request"), floor.cast("long").alias("low"), F.lit(2**62).alias("high")))
        blocks = F.array("seed") if seed else F.array_remove(F.sequence("first_block", "last_block"), F.col("seed"))
        asking = asking.select(F.explode(blocks).alias("block"), part.alias("part"), *columns, request.alias("requests"))
        return _search(asking, mine, True, positives)

    seeds = stage.write(positive_pass(None, True), "positive_seeds")
    floors = _floors(_first(seeds, positives), positives)
    rest = positive_pass(floors, False)
    best = stage.write(_first(seeds.union(rest), positives).select(
        "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    stage.drop("positive_seeds")

    # integer ends of the band: band[0] * p <= 100 * s <= band[1] * p
    p = F.col("positive_score")
    asked = stage.write(
        best.filter(p >= 0).select("anchor_id", p.alias("request")).distinct()
        .withColumn("low", F.expr(f"({band[0]} * request + 99) div 100"))
        .withColumn("high", F.expr(f"({band[1]} * request) div 100")), "requests")
    n_parts = max(1, -(-anchors.count() // ANCHOR_ROWS))
    first = max(fullest.values())[1]
    n_blocks = sum(n for _, _, n, _ in spans)
    each = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_parts))

    def negative_pass(low: DataFrame, seed: bool) -> DataFrame:
        mine = rows.filter((F.col("block") == first) if seed else (F.col("block") != first))
        mine = mine.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_parts - 1).cast("long"))).alias("part"), *columns)
        wanted = low.groupBy(F.col("anchor_id").alias("vec_id")).agg(
            F.collect_list(F.struct("request", "low", "high")).alias("requests"))    # at most one per positive
        blocks = F.array(F.lit(first).cast("long")) if seed else F.array_remove(
            F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")), F.lit(first).cast("long"))
        asking = anchors.join(wanted, "vec_id").select(
            F.explode(blocks).alias("block"), each.cast("long").alias("part"), *columns, "requests")
        return _search(asking, mine, False, negatives)

    seeds = stage.write(negative_pass(asked, True), "negative_seeds")
    floors = _floors(_first(seeds, negatives), negatives)
    raised = (asked.join(floors, ["anchor_id", "request"], "left")
              .select("anchor_id", "request", F.greatest("low", F.coalesce("floor", "low")).alias("low"), "high"))
    hits = _first(seeds.union(negative_pass(raised, False)), negatives).select(
        "anchor_id", F.col("request").alias("positive_score"), F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return best.join(hits, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


#: The operator's query in SQL: anchors divisible by 50, labels moved on where 7 divides the id.
NEGATIVES_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, o.vec_id AS other, a.label = o.label AS same,
         CAST(list_dot_product(a.v, o.v) AS BIGINT) AS score
  FROM e a JOIN e o ON a.vec_id <> o.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other) AS INTEGER) AS rank,
       n.other AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other) <= 3
"""
