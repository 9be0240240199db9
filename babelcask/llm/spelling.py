"""Spelling variants by permuterm rotations.

A word with a terminator, ``w$``, has length + 1 rotations ``w[j:] $ w[:j]``.
In the sorted list of all rotations, the words that arise from each other by
replacing one code point stand in one prefix range: the rotation that ends
with the edited code point, without it.  A word with that code point deleted
is the prefix itself.  So every rotation enters the list in two roles: whole
(the word as the shorter one), and cut before its last code point (the word as
the longer, or replaced, one).  The list is sorted and scanned by its keys
(Spark's sort aggregation on hash ranges of the key; a prefix range never
spans tasks); a scanned group is one shorter word at most and one longer word
per code point of the alphabet, so it has a proven bound of 91 members.  Of a
group each member takes the number of its neighbours and the best one (the
first or second of the sorted members), never all pairs.

Two words that differ by one replaced code point share one key only.  An
inserted code point next to an equal one gives several keys for the same pair
of words; only the first of such a run counts.

Words travel as numbers whose order is the words' code-point order.  Keys of
up to ``LITERAL`` code points are the rotations themselves; longer ones are
(length, place, polynomial hash modulo 2**127 - 1) of the same string, since
the rotations of a word of a million letters would be a million times as long.
Roots follow forms by pointer doubling: counts at least double along a chain,
so there are few rounds.

Defined cases: a null text has no words; a null id reads as an empty text in
the hash; repeated rows count again; empty tables give no rows; words without
near words have ``n_near`` 0 and themselves as root; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from babelcask.llm.work import Staging, is_empty
from babelcask.operators.ranking import numbered

RUN = r"([A-Za-zÀ-ÿ]+)"
SLIP = 97
MIN_LENGTH, MIN_COUNT = 5, 3
#: Longest base (code points) whose keys are rotations written out.
LITERAL = 64
_PRIME, _BASE = 2**127 - 1, 0x5DEECE66D5DEECE66D5DEECE66D
KEYS = "key string, id long, n long, edited string, first boolean"


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    plain = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(c.rlike("[A-Z]"), plain).otherwise(c)


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the runs of ``docs(doc_id, text)``, one code point deleted where the run's hash says so."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("owner"),
                       F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(1))).alias("run"))
    runs = runs.filter(F.char_length("run") >= min_length).select("owner", lower_ascii(F.col("run")).alias("run"))
    h = F.crc32(F.concat("owner", F.lit(":"), "run").cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    cut = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    slipped = runs.withColumn("h", h).withColumn("at", at).select(
        F.when(F.col("h") % SLIP == 0, cut).otherwise(F.col("run")).alias("word"))
    return (slipped.filter(F.char_length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= min_count))


def _long_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of words whose base in a role is longer than ``LITERAL``: linear in the word's length."""
    def emit(rows):
        return pa.RecordBatch.from_pydict(dict(zip(("key", "id", "n", "edited", "first"), zip(*rows), strict=True)), schema=_SCHEMA)

    rows: list[tuple] = []
    for batch in batches:
        for word, number, n in zip(*(batch.column(c).to_pylist() for c in ("word", "id", "n")), strict=True):
            codes = [ord(c) for c in word]
            size = len(codes)
            # head[j], tail[j]: hashes of word[:j] and word[j:]; power[k] = base ** k
            head = list(accumulate(codes, lambda h, c: (h * _BASE + c) % _PRIME, initial=0))
            power = list(accumulate(range(size), lambda p, _: p * _BASE % _PRIME, initial=1))
            tail = [(head[size] - head[j] * power[size - j]) % _PRIME for j in range(size + 1)]
            for j in range(size + 1):
                if size > LITERAL:
                    rows.append((f"{size}:{j}:{head[size]:x}", number, n, None, False))
                if j and size - 1 > LITERAL:
                    rest = (head[j - 1] * power[size - j] + tail[j]) % _PRIME
                    rows.append((f"{size - 1}:{j - 1}:{rest:x}", number, n, word[j - 1], j == 1 or word[j - 2] != word[j - 1]))
                if len(rows) >= 10_000:
                    yield emit(rows)
                    rows = []
    if rows:
        yield emit(rows)


_SCHEMA = pa.schema([("key", pa.string()), ("id", pa.int64()), ("n", pa.int64()), ("edited", pa.string()), ("first", pa.bool_())])


def rotations(words: DataFrame) -> DataFrame:
    """``words(word, id, n)`` -> (key, id, n, edited, first): every rotation, whole (``edited`` null) and cut."""
    size = F.char_length("word")
    turned = words.filter(size <= LITERAL + 1).select("word", "id", "n", F.explode(F.sequence(F.lit(0), size)).alias("j"))
    whole = F.struct(F.expr("concat(substring(word, j + 1), '$', substring(word, 1, j))").alias("key"),
                     F.lit(None).cast("string").alias("edited"), F.lit(False).alias("first"))
    cut = F.struct(F.expr("concat(substring(word, j + 1), '$', substring(word, 1, j - 1))").alias("key"),
                   F.expr("substring(word, j, 1)").alias("edited"),
                   F.expr("j = 1 OR substring(word, j - 1, 1) <> substring(word, j, 1)").alias("first"))
    roles = (F.when(F.col("j") == 0, F.array(whole))
             .when(size > LITERAL, F.array(cut)).otherwise(F.array(whole, cut)))
    # a word of LITERAL + 1 code points has literal keys as the longer word only
    short = (turned.filter((size <= LITERAL) | (F.col("j") > 0))
             .select("id", "n", F.explode(roles).alias("r"))
             .select("r.key", "id", "n", "r.edited", "r.first"))
    long = words.filter(size > LITERAL).select("word", "id", "n").mapInArrow(_long_keys, KEYS)
    return short.union(long)


def neighbours(keyed: DataFrame) -> DataFrame:
    """(id, n_near, best(rank, id)) per member of a scanned group; ``best.rank`` is minus the neighbour's count."""
    member = F.struct((-F.col("n")).alias("rank"), "id", "edited", "first")
    groups = keyed.groupBy("key").agg(F.array_sort(F.collect_list(member)).alias("all")).filter(F.size("all") > 1)
    groups = groups.select(
        F.filter("all", lambda m: m["edited"].isNotNull()).alias("edits"),
        F.get(F.filter("all", lambda m: m["edited"].isNull()), F.lit(0)).alias("base"))
    place = lambda m: F.struct(m["rank"].alias("rank"), m["id"].alias("id"))
    inserted = F.filter("edits", lambda m: m["first"])
    of_base = F.struct(
        F.col("base.id").alias("id"), F.size(inserted).cast("long").alias("n_near"),
        place(F.get(inserted, F.lit(0))).alias("best"))

    def of_edit(m):
        grown = m["first"] & F.col("base").isNotNull()
        other = F.when(F.col("edits")[0]["id"] == m["id"], F.get("edits", F.lit(1))).otherwise(F.col("edits")[0])
        return F.struct(
            m["id"].alias("id"), (F.size("edits") - 1 + F.when(grown, 1).otherwise(0)).cast("long").alias("n_near"),
            F.least(F.when(other.isNotNull(), place(other)), F.when(grown, place(F.col("base")))).alias("best"))

    rows = F.concat(F.transform("edits", of_edit), F.when(F.col("base").isNotNull(), F.array(of_base))
                    .otherwise(F.array().cast("array<struct<id:bigint,n_near:bigint,best:struct<rank:bigint,id:bigint>>>")))
    return groups.select(F.explode(rows).alias("r")).select("r.*").filter("n_near > 0")


def roots(links: DataFrame, stage: Staging) -> DataFrame:
    """``links(id, form_id)`` -> (id, root_id): the last form of each chain, by pointer doubling."""
    now = stage.write(links.select("id", F.col("form_id").alias("root_id")), "roots_0")
    step = 0
    while True:
        ahead = now.select(F.col("id").alias("root_id"), F.col("root_id").alias("next"))
        joined = now.join(ahead, "root_id", "left")
        if is_empty(joined.filter("next IS NOT NULL")):
            return now
        step += 1
        now = stage.write(joined.select("id", F.coalesce("next", "root_id").alias("root_id")), f"roots_{step}")
        stage.drop(f"roots_{step - 1}")


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word of ``docs(doc_id, text)``."""
    stage = Staging(docs.sparkSession, "spelling")
    counted = numbered(word_counts(docs.select("doc_id", "text"), min_length, min_count), ["word"], "id", prefix="words")
    words = stage.write(counted, "words")
    near = (neighbours(rotations(words))
            .union(words.select("id", F.lit(0).cast("long"), F.lit(None).cast("struct<rank:bigint,id:bigint>")))
            .groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best")))
    scanned = stage.write(
        words.join(near, "id").withColumn("taken", -F.col("best.rank") >= 2 * F.col("n"))
        .select("id", "word", "n", "n_near", F.when(F.col("taken"), F.col("best.id")).alias("form_id"),
                F.when(F.col("taken"), -F.col("best.rank")).alias("form_n")), "scanned")
    last = roots(scanned.filter("form_id IS NOT NULL").select("id", "form_id"), stage)
    names = words.select(F.col("id").alias("form_id"), F.col("word").alias("form"))
    ends = words.select(F.col("id").alias("root_id"), F.col("word").alias("root"))
    named = (scanned.filter("form_id IS NOT NULL").join(last, "id").join(names, "form_id").join(ends, "root_id")
             .select("word", "form", "root", "n", "n_near", "form_n"))
    alone = scanned.filter("form_id IS NULL").select(
        "word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    return named.union(alone)
