"""Language identification, hard negatives and spelling variants against plain versions, and their defined cases."""

import random

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from babelcask.llm import hard_negatives, language_id, queries, spelling

SF = "/root/testdata/sf0.001"
NEGATIVES = "vec_id long, embedding array<float>, label int, score double, block string, part int, anchor_id long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---------------------------------------------------------------- spelling variants

def variants(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_spelling_equals_brute_force(spark, docs):
    got = sorted((tuple(r) for r in queries.op13_permuterm(spark, SF).collect()), key=lambda r: r[0])
    assert got == brute.spelling_variants([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sum(r[1] is not None for r in got) > 50


def test_spelling_of_dense_words_runs_and_long_words(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(5, 8))) for _ in range(400)]
    words += ["aaaaa", "aaaaaa", "aaaaaaa", "éàéàé", "éàéàéà", "Éàéàé", "x×÷yzz"] * 4
    base = "".join(rng.choice("abcdefgh") for _ in range(63))
    chain = [base, base + "x", base + "xy", base + "xyz", base + "xyzz", base[:30] + "q" + base[31:] + "xy",
             base[:30] + base[31:], base + "xxyz", "z" * 64, "z" * 65, "z" * 66, "z" * 67]
    words += [w for k, w in enumerate(chain) for _ in range(3 + 3 * k)]
    huge = "".join(rng.choice("klmnop") for _ in range(3_000))
    words += [huge] * 7 + [huge[:1500] + huge[1501:]] * 3 + [huge[:99] + "é" + huge[100:]] * 3
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::40])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in spelling.spelling_variants(df).collect()), key=lambda r: r[0])
    assert got == brute.spelling_variants(rows)


def test_spelling_defined_cases(spark):
    text = "hello hello hello hello hello hello, hallo hallo hallo; HELLO ab"
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "12 ?!")]
    df = spark.createDataFrame([(*r, "k", 1, "f") for r in rows], "doc_id long, text string, key string, id int, form string")
    assert sorted(tuple(r) for r in spelling.spelling_variants(df).collect()) == [
        tuple(r) for r in brute.spelling_variants(rows)]
    assert spelling.spelling_variants(df.limit(0)).count() == 0
    assert spelling.spelling_variants(df.filter("doc_id > 1")).columns == ["word", "form", "root", "n", "n_near", "form_n"]


# ---------------------------------------------------------------- hard negatives

def by_sql(spark, df):
    con = duckdb.connect()
    con.register("embeddings", df.select("vec_id", "embedding", "label").toArrow())
    return sorted(con.execute(hard_negatives.NEGATIVES_SQL).fetchall())


def mined(df):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, moved).collect())


def test_negatives_equal_sql_in_many_blocks(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = by_sql(spark, df)
    assert mined(df) == want and want
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 16)
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", 2)
    assert mined(df) == want


def test_negatives_of_clustered_lengths_and_ties(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(1500):
        v = centres[rng.integers(12)] * rng.choice([0.05, 1.0, 3.0]) + rng.normal(size=16) * 0.15
        if i % 3 == 0:
            v = centres[0]                    # a third of all rows: one vector
        rows.append((i, [float(x) for x in v], int(rng.integers(4))))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = mined(df)
    assert got == by_sql(spark, df) and len(got) > 100


def test_pruning_keeps_every_row_that_reaches_the_score():
    rng = np.random.default_rng(1)
    rows = np.floor(rng.normal(size=(500, 8)) * 100)
    rows[:250] = np.floor(rows[:250] / 10) + np.array([400, 0, 0, 0, -300, 0, 0, 0])
    table = pa.table({"vec_id": pa.array(range(500)), "label": pa.array([0] * 500),
                      "v": pa.array(rows.astype(int).tolist(), pa.list_(pa.int64())),
                      "length": pa.array(np.sqrt((rows ** 2).sum(1)))})
    block = hard_negatives._Block(table, 8)
    pruned = 0
    for a in rows[::25]:
        scores = block.rows @ a
        for lowest in np.quantile(scores, [0.3, 0.9, 0.99]):
            at = block.candidates(a, float(np.sqrt((a ** 2).sum())), float(lowest))
            found = set() if at is None else set(np.arange(500)[at])
            assert set(np.flatnonzero(scores >= lowest)) <= found
            pruned += len(found) < 500
    assert pruned > 20


def test_negatives_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 0), (0, [1.0, 0.5], 0), (50, [0.0, 0.0], 1), (1, [1.0, 0.25], 1), (2, [0.75], 2), (3, [0.5, 0.5, 0.5], 3),
            (4, [nan, 1.0], 2), (5, [inf, 1.0], 2), (6, None, 2), (8, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (9, [None, 1.0], 1),
            (10, [], 5), (100, [-1.0, -0.5], 1)]
    df = spark.createDataFrame([(*r, 0.0, "b", 1, 2) for r in rows], NEGATIVES)
    got = mined(df)
    # anchor 0 (label 1): 256, 128; positive 1: 256, 64 -> 73728; negatives within 36864..70041
    assert [r for r in got if r[:2] == (0, 1)] == [(0, 1, 1, 2, 73728, 49152), (0, 1, 2, 3, 73728, 49152)]
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives.hard_negatives(df, F.lit(False)).count() == 0
    # past 2**53 the scores are Python integers: floor(256 * 2**30 * ...) is exact here
    far = 2.0**30
    big = spark.createDataFrame([(0, [far, 1.0], 0), (1, [0.00390625, far], 1), (2, [0.0, far * 0.75], 2)],
                                "vec_id long, embedding array<float>, label int")
    p, n = 2**38 + 256 * 2**38, 256 * 3 * 2**36
    assert mined(big) == [(0, 1, 1, 2, p, n)]


# ---------------------------------------------------------------- languages

def test_languages_of_held_out_documents(spark):
    big = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op11_subword_softmax(spark, big).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"]]
    assert 250 < len(held) < 420
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)
    taken = [r for r in held if r["accepted"]]
    assert len(taken) > 0.9 * len(held) and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in taken]) > 0.99


def test_rejected_and_odd_texts(spark):
    alphabet = {"aa": "abcdefgh", "bb": "ijklmnop", "cc": "éüñßqrst"}
    rng = random.Random(1)
    rows = [(i, " ".join("".join(rng.choices(alphabet[k], k=6)) for _ in range(20)), k)
            for i, k in enumerate(list(alphabet) * 60)]
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 + 3 … ?!", "bb"), (1003, "abba deaf", None), (None, "cafe face", None),
           (1003, "abba deaf", None), (1005, "ijklm nop " * 150_000, None), (1006, "uvwxyz zyxwvu", None), (1007, "h", "zz")]
    df = spark.createDataFrame([(*r, "s", 0.5, True, 7) for r in rows + odd],
                               "doc_id long, text string, lang string, source string, score double, held_out boolean, key int")
    got = language_id.predict(df).collect()
    assert len(got) == len(rows) + len(odd)
    of = {r["doc_id"]: r for r in got}
    for i in (1000, 1001, 1002):
        assert (of[i]["lang_pred"], of[i]["score"], of[i]["accepted"]) == ("und", 0.0, False)
    assert of[1003]["lang_pred"] == of[None]["lang_pred"] == "aa" and of[1005]["lang_pred"] == "bb"
    assert of[1006]["score"] < of[1005]["score"]
    assert np.mean([of[r[0]]["lang_pred"] == r[2] for r in rows]) > 0.99
    nothing = language_id.predict(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"} and len(nothing) == len(got)
    assert language_id.predict(df.limit(0)).count() == 0
    single = language_id.predict(df.filter("lang = 'aa'")).filter("score > 0").collect()
    assert {(r["lang_pred"], r["score"]) for r in single} == {("aa", 1.0)}


def test_copies_do_not_crowd_out_a_language(spark):
    rows = [(i, "same text again", "aa") for i in range(900)]
    rows += [(1000 + i, f"{'bcd efg'[i % 6:]} dabe fagab {'abcdefg'[i % 7]} badge", "aa") for i in range(60)]
    rows += [(2000 + i, f"uvw xyz {'uvwxyz'[i % 6]} wuz yxvu", "bb") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language_id.fit_sample(df, fit_rows=100).collect()
    texts = {(r["lang"], r["text"]) for r in sample}
    assert len(texts) == len(sample) <= 100 and {r["lang"] for r in sample} == {"aa", "bb"}
    assert sum(r["lang"] == "aa" for r in sample) > 20


def test_subwords_do_not_depend_on_the_cut(monkeypatch):
    texts = pa.array(["Hello, world", None, "", "é ß", "a  b 12 c", "x" * 50 + " " + "yz " * 40, "last"])

    def tally():
        out = {}
        for first, data, offsets in language_id._pieces(texts):
            for owner, ids in language_id.subwords(data, offsets[:-1]):
                for o, i in zip(owner, ids, strict=True):
                    out[first + int(o), int(i)] = out.get((first + int(o), int(i)), 0) + 1
        return out
    whole = tally()
    monkeypatch.setattr(language_id, "PIECE", 60)
    assert tally() == whole
    words = [b"<hello>", b"<world>"]
    assert sum(n for (t, _), n in whole.items() if t == 0) == sum(len(w) - k + 1 for w in words for k in (2, 3, 4))
