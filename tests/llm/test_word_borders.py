"""Kneser-Ney scores of whole texts against a plain Python version, and what grams across word borders must tell."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from babelcask.llm import perplexity, toxicity


def stream(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    return b"\n" + b" ".join(words) + b" " if words else b""


def grams(text):
    s = stream(text)
    return [s[max(0, p - 4): p + 1] for p in range(1, len(s))]


def discounts(counts):
    n = Counter(counts.values())
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
    out = []
    for k in (1, 2, 3):
        cut = max(0, k - (k + 1) * y * n[k + 1] / n[k]) if n[k] and n[1] and n[2] else 0.5 * k
        out.append(min(0.95 * k, max(0.1, cut)))
    return out


class Level:
    """Discounted shares and backoff weights of one table of counts."""

    def __init__(self, counts):
        d = discounts(counts)
        self.total, self.cut, self.counts = Counter(), defaultdict(float), counts
        self.d = lambda c: d[min(c, 3) - 1]
        for g, c in counts.items():
            self.total[g[:-1]] += c
            self.cut[g[:-1]] += self.d(c)

    def share(self, g):
        c = self.counts.get(g, 0)
        return (c - self.d(c)) / self.total[g[:-1]] if c else 0.0

    def left(self, context):
        return self.cut[context] / self.total[context] if self.total[context] else 1.0


class Model:
    def __init__(self, raw):
        self.levels, above = {}, {}
        for size in range(5, 0, -1):
            counts = Counter({g: c for g, c in raw.items() if len(g) == size})
            counts.update(Counter(g[1:] for g in above))
            self.levels[size] = Level(counts)
            above = counts

    def prob(self, g):
        if not g:
            return 1 / 256
        at = self.levels[len(g)]
        return at.share(g) + at.left(g[:-1]) * self.prob(g[1:])


def invented(seed, n):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    return [" ".join(rng.choice(vocab) + rng.choice(["", "", ".\n", " \t"]) for _ in range(rng.randint(0, 70))) for _ in range(n)]


def test_perplexity_equals_plain_version(spark):
    rows = [(d, t, "xx" if d % 3 else "yy") for d, t in enumerate(invented(1, 60))]
    rows += [(60, None, "xx"), (61, "", "yy"), (62, "a", "xx"), (63, "a b c", None), (64, "a b c", None)]
    raw = defaultdict(Counter)
    for _, t, lang in rows:
        raw[lang].update(grams(t))
    models = {lang: Model(counts) for lang, counts in raw.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for limit in (10**6, 0):
        got = {r.doc_id: r.log_perplexity for r in perplexity.score(df, local_rows=limit).collect()}
        for d, t, lang in rows:
            n = len(stream(t).split())
            want = -sum(math.log(models[lang].prob(g)) for g in grams(t)) / n if n else None
            assert got[d] == (pytest.approx(want, rel=1e-5) if n else None)


def test_order_of_words_has_a_part(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rows = [r for r in docs.collect() if r.text and len(r.text.split()) >= 50 and len(set(r.text.split())) >= 25]
    turned = [(r.doc_id + 10**9, " ".join(sorted(r.text.split())), r.lang) for r in rows[::10]]
    both = docs.union(spark.createDataFrame(turned, docs.schema))
    # the models learn from the texts as they are: sorted copies among them would teach their own order
    got = {r.doc_id: r.log_perplexity for r in perplexity.score(both, corpus=docs).collect()}
    worse = sum(got[d] > got[d - 10**9] for d, _, _ in turned)
    assert len(turned) > 50 and worse >= 0.95 * len(turned)


def labelled(texts, toxic):
    return [(d, t) for d, t in enumerate(texts)], [(d, int(d in toxic)) for d in range(len(texts))]


def test_toxic_evidence_equals_plain_version(spark):
    texts = invented(2, 80)
    rows, labels = labelled(texts, set(range(0, 80, 4)))
    part = lambda d: zlib.crc32(str(d).encode()) % 4
    raw = {1: Counter(), 0: Counter()}
    for (d, t), (_, y) in zip(rows, labels, strict=True):
        if part(d) in (0, 1):
            raw[y].update(grams(t.lower()))
    pooled, side = Model(raw[0] + raw[1]), {y: Level(c) for y, c in raw.items()}
    chance = lambda y, g: side[y].share(g) + side[y].left(g[:-1]) * pooled.prob(g)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    for limit in (10**6, 0):
        got = {r.doc_id: r for r in toxicity.score(docs, lab, local_rows=limit).collect()}
        for d, t in rows:
            of_word, at = [], -1
            s = stream(t.lower())
            for p, g in enumerate(grams(t.lower()), 1):
                if s[p - 1: p] in (b"\n", b" "):
                    of_word.append(0.0)
                    at += 1
                of_word[at] += math.log(chance(1, g)) - math.log(chance(0, g))
            mean = sum(of_word) / max(len(of_word), 1)
            wide = [sum(of_word[i: i + 16]) / 16 for i in range(len(of_word) - 15)]
            assert got[d].mean_evidence == pytest.approx(mean, abs=1e-5)
            assert got[d].peak_evidence == pytest.approx(max(wide, default=mean), abs=1e-5)


def test_expression_of_two_ordinary_words(spark):
    """Both words are common on each side; only one next to the other tells the classes apart."""
    rng = random.Random(3)
    calm = "river stone paper window garden quiet lamp table north".split()
    texts, toxic = [], set(range(0, 800, 4))
    for d in range(800):
        words = [rng.choice(calm) for _ in range(40)]
        for i in (5, 15, 25):
            words[i:i + 2] = ["rotten", "eggs"] if d in toxic else ["eggs", "rotten"]
        texts.append(" ".join(words))
    rows, labels = labelled(texts, toxic)
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"),
                         spark.createDataFrame(labels, "doc_id long, toxic int")).filter("held_out").collect()
    assert sum(r.predicted == (r.doc_id in toxic) for r in got) >= 0.97 * len(got)
