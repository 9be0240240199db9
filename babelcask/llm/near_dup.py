"""b-bit MinHash near-duplicate classes of documents.

A document's set: the 64-bit hashes of its distinct 4-word shingles (words
``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased); a text with fewer words is one
shingle; a text without words has the empty set and is linked with nothing.
Two documents are linked if ``100 * |A & B| >= 80 * |A | B|`` on the full sets.

Method: 512 minima per set; 64 bands of 8 minima give band keys, the low 2
bits of every minimum are packed into 16 longs.  At similarity 0.8 a pair
shares no band key with probability 8e-6, at 0.4 one key in 1500 agrees.
Candidates of a band key are first estimated from the packed bits: ``m`` equal
fields of 512 estimate ``(m/512 - 1/4) / (1 - 1/4)``; below 0.69 (5 standard
errors under 0.8) a pair goes no further.  The rest is confirmed on the full sets.

Large groups: equal sets become one representative first.  In the first round
a band key's members are compared with one member only, which
joins a group of n near copies by n - 1 comparisons: the member with the
smallest share of shingles that no other candidate has.  Before, a
member goes out of a key if its other shingles are too few for a link with
any member (an exact bound).  Further rounds compare
the members that are in other components than a random member of their key
with that member, as long as rounds find links and the pairs left over (same
key, different components) outnumber the members ``LEFT_OVER`` times.

What is left over then is found by the members' differences from a hub ``H``,
``dX = (X - H) | (H - X)``; open keys that share a member share one hub, so each
member has one and its differences are made once.  A link is ``9 * |A ^ B| <= |A| + |B|`` (``^``:
in one of both), and ``|A ^ B| = |dA| + |dB| - 2 |dA & dB|``, so linked members
share at least ``t = (|dA| + |dB| - (|A| + |B|) / 9) / 2`` elements of their
differences; t is above 0 whenever one of them is not linked with H (two that
are linked with H are in one component already).  With the elements in one
order, rarest first, two such members must meet in the first ``|d| - t + 1``
elements of each.  Members of a hub are put in buckets by size of difference
and set, so t is known per pair of buckets, and an equi-join on (hub, both
buckets, element) finds every pair; elements that one component alone has are
only counted, and buckets without t others are not faced at all.  Members that differ from the hub each in its own way meet
nowhere, so a large group of unlinked near copies costs its elements, not its
pairs, and no link that could join two components is skipped.

Equal sets are one numbered node, whatever ids carry them, so an id with
several texts is several nodes, tied to one document at the end.

Defined cases: a null text has no words; rows with equal ``doc_id`` are one
document (the same ``component_id``), joined to all that is linked with any of
its texts; a row with a null ``doc_id`` is linked with nothing and kept; no
rows give no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from babelcask.llm import tokens as T
from babelcask.llm.bitfilter import make_filter, passing
from babelcask.llm.components import components
from babelcask.llm.work import Staging, is_empty
from babelcask.operators.ranking import numbered

WIDTH = 4
BANDS, ROWS, BITS = 64, 8, 2
MINIMA = BANDS * ROWS
ESTIMATE_FLOOR = 0.69
LEFT_OVER = 1.0
SIMILAR, OF = 80, 100
#: Sets are held this many shingles (and rows) at a time.
PART_SHINGLES, PART_ROWS = 1_000_000, 2000

_rng = np.random.Generator(np.random.PCG64(7))
_FLIP = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64)
_TURN = _rng.integers(0, 2**62, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SIGNATURE = "doc_id long, n_shingles long, digest binary, bands array<long>, packed array<long>"


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for first, last, w in T.chunks(texts, lower=True):
        hashes = w.hashes()
        grams = T.gram_hashes(hashes, WIDTH)
        for r in range(last - first):
            a, b = w.rows[r], w.rows[r + 1]
            if b - a >= WIDTH:
                yield np.unique(grams[a: b - WIDTH + 1])
            elif b > a:
                yield T.mix(T.gram_hashes(hashes[a:b], int(b - a)) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def _signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (sets x 64) and packed low bits (sets x 16) of non-empty sets."""
    minima = np.empty((len(sets), MINIMA), np.uint64)
    i = 0
    while i < len(sets):
        j, total = i, 0
        while j < len(sets) and (j == i or total + len(sets[j]) <= 60_000):  # stays in the CPU's cache
            total += len(sets[j])
            j += 1
        flat = np.concatenate(sets[i:j])
        at = np.cumsum([0, *(len(s) for s in sets[i: j - 1])])
        out = np.empty_like(flat)
        for k in range(MINIMA):
            np.bitwise_xor(flat, _FLIP[k], out=out)
            np.multiply(out, _TURN[k], out=out)
            minima[i:j, k] = np.minimum.reduceat(out, at)
        i = j
    minima = T.mix(minima.ravel()).reshape(minima.shape)
    banded = minima.reshape(len(sets), BANDS, ROWS)
    keys = np.full((len(sets), BANDS), 0, np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        keys = T.mix((keys * np.uint64(0x9E3779B97F4A7C15) + banded[:, :, r]).ravel()).reshape(keys.shape)
    low = (minima & np.uint64(2**BITS - 1)).reshape(len(sets), MINIMA * BITS // 64, 64 // BITS)
    packed = np.zeros(low.shape[:2], np.uint64)
    for f in range(64 // BITS):
        packed |= low[:, :, f] << np.uint64(BITS * f)
    return keys.view(np.int64), packed.view(np.int64)


def _parts(sets: Iterator[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sets) over runs of at most ``PART_SHINGLES`` shingles (a longer set alone) and ``PART_ROWS`` rows."""
    first, held, total = 0, [], 0
    for s in sets:
        if held and (total + len(s) > PART_SHINGLES or len(held) == PART_ROWS):
            yield first, held
            first, held, total = first + len(held), [], 0
        held.append(s)
        total += len(s)
    if held:
        yield first, held


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, sets in _parts(shingle_sets(batch.column("text"))):
            full = [s for s in sets if len(s)]
            keys, packed = _signatures(full) if full else (np.zeros((0, BANDS), np.int64), np.zeros((0, MINIMA * BITS // 64), np.int64))
            sizes = np.array([len(s) for s in sets], np.int64)
            at = np.concatenate([[0], np.cumsum(sizes > 0)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(first, len(sets)), pa.array(sizes),
                pa.array([_digest(s) for s in sets], pa.binary()),
                pa.ListArray.from_arrays(at * BANDS, pa.array(keys.ravel())),
                pa.ListArray.from_arrays(at * packed.shape[1], pa.array(packed.ravel()))],
                names=["doc_id", "n_shingles", "digest", "bands", "packed"])


def _sets(wanted):
    """Sets of the documents whose id passes the filter, with their digests."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            keys = T.mix(batch.column("doc_id").to_numpy().astype(np.int64).view(np.uint64))
            batch = batch.take(pa.array(passing(bits, keys)))
            for first, sets in _parts(shingle_sets(batch.column("text"))):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(sets)), pa.array([_digest(s) for s in sets], pa.binary()),
                     pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "digest", "shingles"])
    return run


def _elements(column: str, *keys: str):
    """One row per element of a packed set, with the columns ``keys``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in _parts(np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(column)):
                sizes = [len(x) for x in sets]
                owners = [np.repeat(batch.column(k).slice(first, len(sets)).to_numpy(), sizes) for k in keys]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), *map(pa.array, owners)], names=["shingle", *keys])
    return run


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of a member's and its hub's sets, and the shingles that only one of both has."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            part = batch.slice(lo, 200)
            mine, hubs = ([np.frombuffer(x.as_buffer(), np.int64) for x in part.column(c)] for c in ("set_a", "set_b"))
            apart = [np.setxor1d(x, y, assume_unique=True) for x, y in zip(mine, hubs, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("b"), part.column("a"), part.column("comp"),
                 pa.array([len(x) for x in mine], pa.int64()), pa.array([len(x) for x in hubs], pa.int64()),
                 pa.array([len(x) for x in apart], pa.int64()), pa.array([x.tobytes() for x in apart], pa.binary())],
                names=["hub", "rep", "comp", "n", "hub_n", "nd", "apart"])


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = T.mix(batch.column(0).to_numpy().astype(np.int64).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["key"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """The link rule on two sorted sets of distinct hashes."""
    if not len(a) or not len(b):
        return False
    if len(a) > len(b):
        a, b = b, a
    place = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int(np.count_nonzero(b[place] == a))
    return OF * both >= SIMILAR * (len(a) + len(b) - both)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("set_a"), batch.column("set_b")
        keep = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))
                for x, y in zip(a, b, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def estimate(x, y):
    """Collision-corrected similarity of two packed signatures."""
    ones = int("1" * (64 // BITS), 2**BITS)
    def differ(p, q):
        d = p.bitwiseXOR(q)
        for k in range(BITS - 1):
            d = d.bitwiseOR(F.shiftrightunsigned(p.bitwiseXOR(q), k + 1))
        return F.bit_count(d.bitwiseAND(F.lit(ones)))
    apart = F.aggregate(F.zip_with(x, y, differ), F.lit(0), lambda s, n: s + n)
    chance = 2.0 ** -BITS
    return (1 - apart / MINIMA - chance) / (1 - chance)


def _likely(pairs: DataFrame, packed: DataFrame) -> DataFrame:
    """Pairs (a, b) whose estimated similarity reaches the floor."""
    side = lambda c: packed.select(F.col("rep").alias(c), F.col("packed").alias(f"p{c}"))
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .filter(estimate(F.col("pa"), F.col("pb")) >= ESTIMATE_FLOOR).select("a", "b"))


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    side = lambda c: sets.select(F.col("rep").alias(c), F.col("shingles").alias(f"set_{c}"))
    # the many different members first: their sets meet the short pair rows, then each pair meets its hub's set
    return pairs.join(side("b"), "b").join(side("a"), "a")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    return _with_sets(pairs, sets).select("a", "b", "set_a", "set_b").mapInArrow(_confirm, "a long, b long")


def _at_hubs(rest: DataFrame, grouped: DataFrame, info: DataFrame, stage: Staging) -> DataFrame:
    """``rest(key, rep, comp)`` -> (hub, rep, comp): every member once, at the one hub of all it may be linked with.

    Open keys that share a member share a hub, so members of one key have the
    same one, and a member's differences are made once, not once per key's hub.
    """
    ties = (rest.join(grouped.select("key", "hub").distinct(), "key").filter("rep <> hub")
            .select(F.col("rep").alias("a"), F.col("hub").alias("b")))
    named = components(ties, stage, "hubs").select(F.col("a").alias("rep"), F.col("b").alias("name"))
    members = (rest.select("rep", "comp").distinct().join(named, "rep", "left")
               .select("rep", "comp", F.coalesce("name", "rep").alias("name")))
    hubs = (members.join(info, "rep").groupBy("name")
            .agg(F.min(F.struct((F.col("lone") / F.col("n")).alias("odd"), "rep")).alias("hub"))
            .select("name", F.col("hub.rep").alias("hub")))
    return members.join(hubs, "name").select("hub", "rep", "comp")


def _meeting(open_members: DataFrame, sets: DataFrame, stage: Staging) -> tuple[DataFrame, DataFrame]:
    """``open_members(hub, rep, comp)`` -> (links with the hubs, pairs of members that may be linked): see above."""
    both = _with_sets(open_members.select(F.col("rep").alias("a"), F.col("hub").alias("b"), "comp"), sets)
    diff = stage.write(both.select("a", "b", "comp", "set_a", "set_b").mapInArrow(
        _differences, "hub long, rep long, comp long, n long, hub_n long, nd long, apart binary").distinct(), "differences")
    linked = F.expr(f"{OF + SIMILAR} * nd <= {2 * (OF - SIMILAR)} * (n + hub_n) / 2")
    direct = diff.filter(linked & (F.col("rep") != F.col("hub"))).select(
        F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b"))
    elements = diff.select("apart", "hub", "rep", "comp").mapInArrow(
        _elements("apart", "hub", "rep", "comp"), "shingle long, hub long, rep long, comp long")
    # in the order, the elements of one component only come first: no pair that matters shares them
    shared = (elements.groupBy("hub", "shingle").agg(
        F.count("*").alias("owners"), F.min("comp").alias("c"), F.max("comp").alias("d")).filter("c <> d").drop("c", "d"))
    step = lambda c, k: F.floor(k * F.log2(F.col(c) + 1)).cast("int")
    members = diff.drop("apart").select("hub", "rep", "n", "nd", F.struct(
        linked.alias("linked"), step("nd", 8).alias("d"), step("n", 4).alias("s")).alias("bucket"))
    # a member's own elements in the order: ``place`` from 1, ``own`` of them
    mine = Window.partitionBy("hub", "rep")
    placed = stage.write(
        elements.join(shared, ["hub", "shingle"])
        .withColumn("place", F.row_number().over(mine.orderBy("owners", "shingle"))).withColumn("own", F.count("*").over(mine))
        .drop("owners").join(members, ["hub", "rep"]), "placed")
    buckets = stage.write(placed.groupBy("hub", "bucket").agg(
        F.min("nd").alias("d_low"), F.min("n").alias("n_low"), F.max("n").alias("n_high"), F.max("own").alias("most")), "buckets")
    theirs = buckets.select("hub", F.col("bucket").alias("other"), *[F.col(c).alias(f"o_{c}") for c in buckets.columns[2:]])
    # shared elements that a link between the two buckets needs, by the least differences and the largest sets
    need = F.greatest(F.lit(1), F.expr(
        f"CAST(ceil(((d_low + o_d_low) - {2 * (OF - SIMILAR)} * (n_high + o_n_high) / {2 * (OF + SIMILAR)}D) / 2) AS BIGINT)"))
    facing = (buckets.join(theirs, "hub")
              .filter("NOT other.linked AND (bucket.linked OR bucket <= other)")
              .filter(f"{OF} * o_n_high >= {SIMILAR} * n_low AND {OF} * n_high >= {SIMILAR} * o_n_low")
              .withColumn("need", need).filter("need <= most AND need <= o_most").select("hub", "bucket", "other", "need"))
    # one side per pair of buckets: its members' first elements; the other side's elements meet them
    asking = (placed.select("hub", "bucket", "rep", "comp", "shingle", "place", "own").join(facing, ["hub", "bucket"])
              .filter("place <= own - need + 1").select("hub", "other", "shingle", "bucket", "need", "rep", "comp"))
    met = placed.select("hub", F.col("bucket").alias("other"), "shingle", F.col("rep").alias("rep2"), F.col("comp").alias("comp2"),
                        F.col("place").alias("place2"), F.col("own").alias("own2"))
    pairs = (asking.join(met, ["hub", "other", "shingle"])
             .filter("comp <> comp2 AND place2 <= own2 - need + 1 AND (bucket <> other OR rep < rep2)")
             .select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct())
    return direct, pairs


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> (doc_id, n_shingles, component_id, kept), one row per row of ``docs``."""
    stage = Staging(docs.sparkSession, "near_dup")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stage.write(texts.mapInArrow(_sign, SIGNATURE), "signed")
    # equal sets are one node; ``doc``: the least doc_id that carries it
    classes = stage.write(numbered(
        signed.filter("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc")),
        ["digest"], "rep"), "classes")
    member = (signed.filter("doc_id IS NOT NULL").select("doc_id", "n_shingles", "digest")
              .join(classes, "digest", "left").select("doc_id", "n_shingles", "rep", "doc"))
    reps = stage.write(signed.join(classes, "digest").filter("doc_id = doc")
                       .select("rep", "digest", "doc", "bands", "packed").dropDuplicates(["digest"]), "reps")
    keys = reps.select("rep", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    together = stage.write(keys.join(shared, "key"), "together")
    packed = reps.select("rep", "packed")
    # the sets of documents in some group; the filter keeps the other texts from being moved
    wanted = reps.join(together.select("rep").distinct(), "rep", "left_semi").select("rep", "digest", "doc")
    bits = docs.sparkSession.sparkContext.broadcast(make_filter(wanted.select("doc").mapInArrow(_mixed, "key long")))
    sets = stage.write(
        texts.mapInArrow(_sets(bits), "doc_id long, digest binary, shingles binary")
        .join(wanted, "digest").filter("doc_id = doc").select("rep", "shingles"), "sets")
    # shingles of one document only can be in no intersection: |A & B| <= least number of the others
    lone = (sets.mapInArrow(_elements("shingles", "rep"), "shingle long, rep long").groupBy("shingle")
            .agg(F.min("rep").alias("rep"), F.max("rep").alias("last")).filter("rep = last")
            .groupBy("rep").agg(F.count("*").alias("lone")))
    info = stage.write(
        sets.groupBy("rep").agg(F.max(F.octet_length("shingles") / 8).cast("long").alias("n"))
        .join(lone, "rep", "left").select("rep", "n", F.coalesce("lone", F.lit(0)).alias("lone")), "info")
    sized = stage.write(together.join(info, "rep"), "sized")
    least = sized.groupBy("key").agg(F.min("n").alias("least"))
    # a link needs |A & B| >= 80/180 (|A| + |B|)
    able = sized.join(least, "key").filter(
        F.expr(f"{OF + SIMILAR} * (n - lone) >= {SIMILAR} * (n + least)")).select("key", "rep", "n", "lone")
    hubs = (able.groupBy("key").agg(F.min(F.struct((F.col("lone") / F.col("n")).alias("odd"), "rep")).alias("hub"),
                                    F.count("*").alias("members")).filter("members > 1")
            .select("key", F.col("hub.rep").alias("hub")))
    grouped = stage.write(able.join(hubs, "key").select("key", "hub", "rep"), "grouped")
    first = (grouped.filter("rep <> hub").select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b"))
             .distinct())
    links1 = stage.write(_links(_likely(first, packed), sets), "links1")
    comp, turn = components(links1, stage, "round1"), 1
    while True:
        named = (grouped.join(comp.select(F.col("a").alias("rep"), F.col("b").alias("c")), "rep", "left")
                 .select("key", "rep", F.coalesce("c", "rep").alias("comp")))
        open_keys = (named.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"))
                     .filter("x <> y").select("key"))
        rest = stage.write(named.join(open_keys, "key", "left_semi"), f"rest{turn}")
        groups = stage.write(rest.groupBy("key", "comp").agg(F.count("*").cast("double").alias("n")), f"groups{turn}")
        members, left_over = (groups.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"))
                              .agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("nn")) / 2)).first())
        if (left_over or 0) <= LEFT_OVER * (members or 0):
            break
        # a random member of every open key against the members in other components
        pick = rest.groupBy("key").agg(F.min(F.struct(
            F.xxhash64("rep", F.lit(turn)).alias("h"), F.col("rep").alias("hub"), F.col("comp").alias("at"))).alias("p"))
        pairs = (rest.join(pick, "key").filter("comp <> p.at")
                 .select(F.least("rep", "p.hub").alias("a"), F.greatest("rep", "p.hub").alias("b")).distinct())
        more = stage.write(_links(_likely(pairs, packed), sets), f"more{turn}")
        if is_empty(more):      # the components stay, and so does what is left over
            break
        turn += 1
        comp = components(comp.union(more), stage, f"round{turn}")
    more = comp.limit(0)
    if members:
        direct, second = _meeting(stage.write(_at_hubs(rest, grouped, info, stage), "at_hubs"), sets, stage)
        more = direct.union(stage.write(_links(_likely(second, packed), sets), "links2"))
    # a doc_id with several texts is one document: it ties the nodes of its texts
    nodes = member.filter("rep IS NOT NULL")
    several = nodes.groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).filter("x <> y")
    tied = nodes.join(several, "doc_id").select(F.col("x").alias("a"), F.col("rep").alias("b"))
    more = stage.write(more.union(tied), "last")
    if not is_empty(more):
        comp = components(comp.union(more), stage, "all")
    comp = comp.select(F.col("a").alias("rep"), F.col("b").alias("root"))
    # a component is named by the least document of its nodes
    rooted = (classes.select("rep", "doc").join(comp, "rep", "left")
              .select("rep", "doc", F.coalesce("root", "rep").alias("root")))
    least = rooted.join(comp.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("doc").alias("least"))
    named_nodes = (rooted.join(least, "root", "left")
                   .select(F.col("rep").alias("node"), F.coalesce("least", "doc").alias("component_id")))
    named = (nodes.select("doc_id", "n_shingles", F.col("rep").alias("node")).join(named_nodes, "node")
             .select("doc_id", "n_shingles", "component_id"))
    # a text without words is linked with nothing, but follows other texts of its id
    wordless = member.filter("rep IS NULL").select("doc_id", "n_shingles")
    follow = (named.join(wordless.select("doc_id").distinct(), "doc_id", "left_semi")
              .groupBy("doc_id").agg(F.min("component_id").alias("other")))
    wordless = wordless.join(follow, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("other", "doc_id").alias("component_id"))
    out = named.union(wordless).union(signed.filter("doc_id IS NULL").select(
        "doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")))
    return out.select("doc_id", "n_shingles", "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
