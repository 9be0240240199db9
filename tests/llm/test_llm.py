"""Operators against plain Python versions, and their defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import unigram_model
from pyspark.sql import functions as F

import corpus_pipeline
from babelcask.llm import (chat, compact_windows, decontaminate, elias_fano, near_dup, perplexity, pii_vote, piece_lattice,
                           queries, toxicity, trie_lm, url_filter)
from babelcask.llm import tokens as T

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor " * 20_000


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, an empty and a very long text, repeated rows, and extra columns with clashing names."""
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, "one two"), (5, "one two"), (None, "one two three four five"),
            (7, "é\x0bß \x1c b"), (8, "a@b.c 1.2.3.4")]
    return spark.createDataFrame(
        [(d, t, "en" if i % 2 else None, "x", "y", i, "z") for i, (d, t) in enumerate(rows)],
        "doc_id long, text string, lang string, row string, id string, n long, key string")


def empty(df):
    return df.limit(0)


def test_words_and_hashes_match_python():
    texts = ["  Hello, world\n", None, "", "a b  a", "é È\x0bx", "%%% a! a", " "]
    seen = {}
    for first, last, w in T.chunks(pa.array(texts), True, limit=9):
        hashes = w.hashes()
        for r in range(first, last):
            lo, hi = w.rows[r - first], w.rows[r - first + 1]
            got = [bytes(w.data[a:b]).decode() for a, b in zip(w.starts[lo:hi], w.ends[lo:hi], strict=True)]
            assert got == brute.words(texts[r])
            for word, h in zip(got, hashes[lo:hi], strict=True):
                assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


# ---- 1

_BASE = [re.compile(p) for p in (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_base_spans(text):
    out = []
    for k, p in enumerate(_BASE):
        for m in p.finditer(text):
            d = re.sub("[^0-9]", "", m.group())
            good = (True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")),
                    12 <= len(d) <= 19 and pii_vote.luhn(d or "1"), 9 <= len(d) <= 15)[k]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_match_the_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("a1.@-+ %()0é25") for _ in range(rng.randint(0, 30)))
        assert pii_vote.base_spans(text) == plain_base_spans(text), text


def test_secrets_of_any_length_are_candidates():
    pattern = dict(pii_vote._CANDIDATES)["secret"]
    for n in (20, 512, 513, 5000, 300_000):
        token = ("aB3_" * n)[:n]
        assert [m.span() for m in pattern.finditer(f"key {token}, {token[:19]}")] == [(4, 4 + n)]
    assert not pattern.findall("a" * 300_000)


def test_pii_rows(docs, odd):
    for df in (docs, odd):
        texts = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect())
        got = sorted((r.doc_id is None, r.doc_id or 0, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone)
                     for r in pii_vote.find_personal_data(df).collect())
        want = []
        for a, b, t in texts:
            spans = plain_base_spans(t)
            said = ",".join(f"{pii_vote.BASE_KINDS[k]}:{s}:{e}" for s, k, e in spans)
            want.append((a, b, hashlib.sha256(said.encode()).hexdigest(), *[sum(x[1] == k for x in spans) for k in range(4)]))
        assert got == sorted(want)
    assert pii_vote.find_personal_data(empty(docs)).count() == 0


def test_redaction_keeps_rows_and_columns(odd):
    out = pii_vote.redact(odd)
    assert out.schema == odd.schema and out.count() == odd.count()
    assert out.filter("doc_id = 8").first().text == "[EMAIL] [IP]"


def test_em_finds_the_reliable_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(5000) < 0.4
    good = np.where(rng.random((5000, 3)) < 0.9, truth[:, None], ~truth[:, None])
    bad = rng.random((5000, 1)) < 0.5
    votes = np.concatenate([good, bad], 1) * 2 - 1
    posterior, table = pii_vote.em(np.zeros(5000, int), votes, np.ones(5000))
    assert np.mean((posterior > 0.5) == truth) > 0.95
    assert table[1, 0, 2] > 0.85 and abs(table[1, 3, 2] - 0.5) < 0.05


# ---- 2

def test_near_duplicates_match_brute_force(spark, docs):
    want = brute.near_duplicate_classes([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs).collect()}
    assert got == want


def test_near_copies_in_one_large_group(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((d, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near_duplicate_classes(rows)


def test_near_duplicates_defined_cases(odd):
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in near_dup.near_duplicates(odd).collect())
    assert got == [(-1, 2, -1, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 3, 4, True), (5, 1, 5, True),
                   (5, 1, 5, True), (7, 1, 7, True), (8, 1, 8, True)]
    assert near_dup.near_duplicates(empty(odd)).count() == 0


# ---- 3 and 7

def plain_base_rules(text):
    text = text or ""
    w = brute.words(text, lower=False)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    repeated = {i + k for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for k in range(3)}
    seen, lines = set(), 0
    for x in text.split("\n"):
        if brute.words(x):
            lines += x in seen
            seen.add(x)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), lines, len(repeated))


def test_quality_rules(docs, odd):
    for df in (docs, odd):
        want = sorted((r.doc_id is None, r.doc_id or 0, *plain_base_rules(r.text)) for r in df.collect())
        rows = perplexity.score(df).collect()
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
                     for r in rows)
        assert got == want
        for r in rows:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.kept and r.base_failed)
    assert perplexity.score(empty(docs)).count() == 0


def test_bands_of_a_language_of_copies(spark):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    text = lambda: [rng.choice(vocab) for _ in range(80)]
    rows = [(d, text(), lang) for lang, at in (("xx", 0), ("yy", 1000)) for d in range(at, at + 40)]
    base = text()
    rows += [(100 + i, base, "xx") for i in range(120)]
    for i in range(120):
        words = list(base)
        for _ in range(3):
            words[rng.randrange(80)] = rng.choice(vocab)
        rows.append((1100 + i, words, "yy"))
    rows.append((99, ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(6)) for _ in range(80)], "xx"))
    df = spark.createDataFrame([(d, " ".join(t), lang) for d, t, lang in rows], "doc_id long, text string, lang string")
    got = {r.doc_id: r.kept for r in perplexity.score(df).collect()}
    assert all(got[d] for d in (*range(40), *range(1000, 1040))) and not got[99]


def test_perplexity_by_joins_equals_arrays(docs):
    a = {r.doc_id: r for r in perplexity.score(docs).collect()}
    b = {r.doc_id: r for r in perplexity.score(docs, local_rows=0).collect()}
    assert a.keys() == b.keys()
    for d in a:
        assert (a[d].log_perplexity or 0) == pytest.approx(b[d].log_perplexity or 0, rel=1e-6) and a[d].kept == b[d].kept


def test_kneser_ney_sums_to_one(spark, docs):
    from babelcask.llm import char_kn as K
    from babelcask.llm.work import Staging
    langs = {"en": 0}
    full = (docs.filter("lang = 'en'").select("text", "lang").mapInArrow(perplexity._counter(langs), "cls long, g long, c long")
            .groupBy("cls", "g").agg(F.sum("c").alias("c")))
    model = K.HashArrays(K.fit(full, Staging(spark, "test"), "kn").toArrow())
    for context in (b" th", b"e", b"qz", b" in"):
        window = np.array([int.from_bytes((context + bytes([c]))[-5:], "big") for c in range(256)], np.uint64)
        length = np.full(256, min(5, len(context) + 1))
        assert np.exp(model.log_prob(window, length, 0)).sum() == pytest.approx(1, abs=2e-3)


def test_toxicity(spark, docs, odd):
    rng = random.Random(5)
    calm = "the of and river stone paper window garden quiet lamp table north".split()
    foul = "vrukk snarg blotz".split()
    rows, labels = [], []
    for d in range(600):
        toxic = d % 5 == 0
        words = [rng.choice(calm) for _ in range(60)]
        if toxic:
            for _ in range(4):
                words[rng.randrange(20, 30)] = rng.choice(foul)
        rows.append((d, " ".join(words)))
        labels.append((d, int(toxic)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(df, lab).collect()}
    held = [d for d in got if got[d].held_out]
    assert {d for d in got if zlib.crc32(str(d).encode()) % 4 == 2} == set(held)
    assert sum(got[d].predicted == (d % 5 == 0) for d in held) >= 0.97 * len(held)
    by_joins = {r.doc_id: r.score for r in toxicity.score(df, lab, local_rows=0).collect()}
    assert all(by_joins[d] == pytest.approx(got[d].score, abs=1e-6) for d in got)
    assert toxicity.score(odd, lab).count() == odd.count()
    assert all(r.score < 1e-8 for r in toxicity.score(odd, empty(lab)).collect())
    assert toxicity.score(empty(df), lab).count() == 0


# ---- 4

def test_decontamination_against_search(spark, docs, odd):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = bench.collect()
    want = {(d.doc_id, b.item_id) for d in docs.collect() for b in items if b.text in d.text}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got >= want and len(got) <= len(want) + 2
    assert decontaminate.contaminated(odd, bench).count() == 0
    assert decontaminate.contaminated(empty(docs), bench).count() == 0
    assert decontaminate.contaminated(docs, empty(bench)).count() == 0


def test_decontamination_tolerates_substitutions(spark):
    words = [f"t{i}" for i in range(40)]
    changed = [f"z{i}" if i % 9 == 4 else w for i, w in enumerate(words)]
    df = spark.createDataFrame([(1, "before " + " ".join(changed).upper() + ", after"), (2, " ".join(reversed(words)))],
                               "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(words)), (10, None), (11, "two words")], "item_id long, text string")
    got = decontaminate.contaminated(df, bench).collect()
    assert [(r.doc_id, r.item_id, r.item_words) for r in got] == [(1, 9, 40)] and got[0].equal_words >= 34


# ---- 5 and 10

def test_sql_queries_equal_duckdb(spark):
    con = duckdb.connect()
    for t in ("pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, SF)
        cols = sorted(df.columns)
        got = sorted(str(tuple(r)) for r in df.select(cols).collect())
        want = sorted(str(r) for r in con.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall())
        assert got == want, name


def test_chat_reads_back_every_turn(spark):
    rows = [(1, 0, "user", "<|im_end|> <|| <|nl|>"), (1, 1, "user", None), (1, 2, "assistant", "é\n<|im_sep|>"),
            (1, 3, "assistant", "<"), (1, None, "a\nb", ""), (None, 0, None, "x"), (1, 2, "assistant", "é\n<|im_sep|>")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    out = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    said = [(t.role, t.text) for t in out[1].turns]
    assert said == [("a\nb", ""), ("user", "<|im_end|> <|| <|nl|>"), ("user", ""), ("assistant", "é\n<|im_sep|>"),
                    ("assistant", "é\n<|im_sep|>"), ("assistant", "<")]
    assert out[1].loss_text == "é\n<|im_sep|>é\n<|im_sep|><" and [(t.role, t.text) for t in out[None].turns] == [("", "x")]
    assert chat.format_chats(empty(df)).count() == 0


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://COM/x", "http://a.com", "http://example.com/en/?q", "https://x.example.com/en/1",
            "http://m.www.example.com/en/", "http://a.net/es/", "http://net/fr/x://y", "http://a.org/Poker/", "http://poker.org:80"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] * 2, "page_id long, url string, host string")
    rows = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect())[::2]
    assert [r[3:] for r in rows] == [
        (None, "allow"), (None, "allow"), (None, "allow"), ("com/", "allow"), (None, "allow"), ("example.com/en/", "block"),
        ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
        (None, "allow"), (None, "block")]
    assert rows[3][1:3] == ("com", "/x") and url_filter.judge(empty(df)).count() == 0


# ---- 6

def test_elias_fano_and_trie():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, top = int(rng.integers(0, 300)), int(rng.choice([5, 300, 10**4, 2**40, 2**62]))
        v = np.sort(rng.integers(0, top, n).astype(np.uint64))
        ef = elias_fano.EliasFano.build(v)
        assert not n or (ef.get(np.arange(n)) == v).all()
        x = np.concatenate([v, rng.integers(0, top + 5, 50).astype(np.uint64)])
        at, same = ef.successor(x)
        assert (at == np.searchsorted(v, x)).all() and (same == np.isin(x, v)).all()


def test_trie_scores(spark, docs, odd):
    for df in (docs, odd):
        texts = [(r.doc_id, r.text) for r in df.collect()]
        uni, pair = Counter(), Counter()
        train = [t for d, t in texts if not trie_lm.is_held_out(d)]
        for t in train:
            w = [*brute.words(t), "\n"]
            uni.update(w)
            pair.update(zip(["\0", *w[:-1]], w, strict=True))
        n, v = sum(uni.values()), len(uni)
        p1 = lambda y: (uni[y] - .5) / n if uni[y] else .5 * v / n  # noqa: B023, E731
        want = []
        for d, t in texts:
            w = [*brute.words(t), "\n"]
            base = math.fsum(math.log10((uni[y] + .1) / (n + .1 * (v + 1))) for y in w)
            score = math.fsum(math.log10((pair[x, y] * (uni[y] > 0) + 2000 * p1(y)) / ((len(train) if x == "\0" else uni[x]) + 2000))
                              for x, y in zip(["\0", *w[:-1]], w, strict=True))
            want.append((d or -1, len(w), sum(uni[y] > 0 for y in w), n, base, score))
        got = sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.pair_score) for r in trie_lm.score(df).collect())
        for g, e in zip(got, sorted(want), strict=True):
            assert g[:4] == e[:4] and g[4] == pytest.approx(e[4], rel=1e-9) and abs(g[5] - e[5]) < 3e-4 * e[1]
    assert trie_lm.score(empty(docs)).count() == 0


def test_scores_of_the_third_order(docs, odd):
    for df in (docs.limit(60), odd):
        texts = [(r.doc_id, ["\0", *brute.words(r.text), "\n"]) for r in df.collect()]
        train = [t for d, t in texts if not trie_lm.is_held_out(d)]
        uni, pair, triple = (Counter(tuple(t[i: i + k]) for t in train for i in range(len(t) - k + 1)) for k in (1, 2, 3))
        n, v = sum(uni.values()) - uni["\0",], len(uni) - 1

        def p1(y):
            return (uni[y,] - .5) / n if uni[y,] else .5 * v / n  # noqa: B023

        def p2(x, y):
            return (pair[x, y] + 2000 * p1(y)) / (uni[x,] + 2000)  # noqa: B023

        def p3(u, x, y):
            return (triple[u, x, y] + 2000 * p2(x, y)) / (pair[u, x] + 2000)  # noqa: B023

        want = sorted((d or -1, len(t) - 1, math.log10(p2(t[0], t[1])) + math.fsum(
            math.log10(p3(*t[i - 2: i + 1])) for i in range(2, len(t)))) for d, t in texts)
        got = sorted((r.doc_id or -1, r.n_tokens, r.score) for r in trie_lm.score(df).collect())
        for g, e in zip(got, want, strict=True):
            assert g[:2] == e[:2] and abs(g[2] - e[2]) < 5e-4 * e[1]


# ---- 8

def test_pieces_equal_the_library_and_round_trip(spark, docs, odd):
    library = sentencepiece.SentencePieceProcessor(model_proto=unigram_model.as_unigram(piece_lattice.MODEL))
    texts = sorted({u for r in docs.limit(40).collect() for u in re.findall(r" ?[^ \n]+", r.text)})[:3000]
    texts += ["", " a", "   ", "\n\n x \n", "new\tç 漢字😀", "hello  world", "x" * 700]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in piece_lattice.encode(rows).collect()}
    assert all(got[i] == library.encode(t) for i, t in enumerate(texts))
    strange = spark.createDataFrame([(1, "\u2581 \u2581\u2581 a\u2581b \uffff"), (2, "\x00")], "doc_id long, text string")
    for df in (docs, odd, strange):
        out = piece_lattice.round_trip(df)
        assert out.count() == df.count() and out.filter("NOT round_trip").count() == 0
        back = piece_lattice.decode(piece_lattice.encode(df))
        assert back.filter(F.sha2("text", 256) != F.col("text_sha256")).count() == 0 and back.count() == df.count()
    assert piece_lattice.round_trip(empty(docs)).count() == 0


# ---- 9

def test_compact_windows_match_the_definition():
    rng = np.random.default_rng(0)
    for _ in range(100):
        n, span = int(rng.integers(1, 60)), int(rng.integers(2, 9))
        v = np.concatenate([[0], (rng.permutation(1000)[:n].astype(np.uint64) + np.uint64(1)) << np.uint64(22), [0]])
        v = v.astype(np.uint64) | np.arange(n + 2, dtype=np.uint64)
        want = []
        for i in range(1, n + 1):
            a = b = i
            while v[a - 1] > v[i]:
                a -= 1
            while v[b + 1] > v[i]:
                b += 1
            if b - a + 1 >= span:
                want.append((a, i, b))
        assert list(zip(*compact_windows.compact_windows(v, span), strict=True)) == want


def test_repeated_passages(spark, docs, odd):
    rng = random.Random(2)
    words = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    shared, rows = words(70), []
    for d in range(12):
        rows.append((d, f"{words(90)} {shared} {words(40)}" if d % 3 == 0 else words(200)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = compact_windows.repeated_passages(df).collect()
    assert {r.doc_id for r in got} == {0, 3, 6, 9}
    assert all((r.start_word, r.end_word, r.similarity) == (90, 160, 1.0) for r in got)
    assert compact_windows.repeated_passages(odd).count() == 0
    assert compact_windows.repeated_passages(empty(docs)).count() == 0


def plain_passage(x, y):
    """Whether two texts of equally placed words hold a passage: at least 50 words whose shingle sets have a Jaccard of 0.8."""
    x, y = ([tuple(t[i: i + 5]) for i in range(len(t) - 4)] for t in (x, y))
    for i in range(len(x) - 45):
        for j in range(i + 46, len(x) + 1):
            a, b = set(x[i:j]), set(y[i:j])
            if 5 * len(a & b) >= 4 * len(a | b):
                return True
    return False


def test_near_copies_are_compared_beyond_their_first_document(spark):
    rng = random.Random(9)
    rows = []
    for size in (50, 60, 80):
        passage = [f"s{size}.{i}" for i in range(size)]
        for d in range(40):
            words = list(passage)
            # the least id is far from all others: nothing is found through it
            for i in range(0, size, 9) if d == 0 else rng.sample(range(size), rng.randint(0, 3)):
                words[i] = f"x{rng.randrange(10**9)}"
            rows.append((1000 * size + d, words))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    got = {r.doc_id for r in compact_windows.repeated_passages(df).collect()}
    want = set()
    for d, x in rows:
        if any(e != d and e // 1000 == d // 1000 and plain_passage(x, y) for e, y in rows):
            want.add(d)
    assert got <= want and len(want - got) <= 0.03 * len(want)
    exact = {}
    for d, x in rows:
        exact.setdefault(" ".join(x), []).append(d)
    assert all(d in got for same in exact.values() if len(same) > 1 for d in same)


def test_a_passage_that_stands_twice_in_a_document(spark):
    rng = random.Random(4)
    words = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    shared = words(70)
    rows = [(1, f"{words(30)} {shared} {words(25)} {shared} {words(10)}"), (2, f"{shared} {words(90)} {shared}"),
            (3, f"{words(60)} {shared}"), (4, words(200))]
    got = compact_windows.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.start_word, r.end_word) for r in got} == {(1, 30, 100), (1, 125, 195), (2, 0, 70), (2, 160, 230), (3, 60, 130)}


def test_two_texts_that_repeat_themselves(spark):
    df = spark.createDataFrame([(1, LONG), (2, "x y z " + LONG[: 18 * 400])], "doc_id long, text string")
    got = compact_windows.repeated_passages(df).collect()
    assert {r.doc_id for r in got} == {1, 2} and (2, 3, 1203) in {(r.doc_id, r.start_word, r.end_word) for r in got}


def test_a_chunk_of_more_words_than_the_limit(monkeypatch):
    texts = pa.array([" ".join(f"w{i * i % 1009}" for i in range(400)), "a b c", " ".join(f"z{i}" for i in range(90))])
    _, _, w = next(T.chunks(texts, True))
    wide = compact_windows.text_windows(w, np.arange(3))
    monkeypatch.setattr(compact_windows, "_PLACES", 16)
    assert (compact_windows.text_windows(w, np.arange(3)) == wide).all() and len(wide)


# ---- pipeline

def test_pipeline_stages(spark, docs):
    now = docs
    for name, step in corpus_pipeline.STAGES:
        before, now = now, step(spark, now, SF).persist()
        if name != "pieces":
            assert now.columns == docs.columns
        assert {r.doc_id for r in now.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "minhash_dedup":
            want = brute.near_duplicate_classes([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id for r in now.collect()} == {d for d, (_, c) in want.items() if c == d}
    assert now.filter("NOT round_trip").count() == 0
    assert step(spark, docs.limit(0), SF).count() == 0
