"""Personal data by weak supervision.

Base spans follow fixed patterns (``base_spans``).  Further candidates
(secrets, account numbers, national phone numbers, spelled-out addresses,
handles) get votes from labelers: a strict regex, a gazetteer of trigger
words, the characters around, the shape, and a checksum.  Each votes yes, no or
abstains.  Expectation-maximisation over the counted vote patterns estimates
every labeler's reliability per kind group and a posterior for every pattern;
a logistic span classifier is then trained on the spans' own features with
the posteriors as soft labels, and decides which candidates join the base
spans.  Base spans take part in the estimation and always stay.

Scale: texts are read once; what leaves the scan is one short row per
document.  Patterns are counted by ``groupBy``: at most kinds x 3**5 vote
patterns and kinds x 4*4*3*3*3*2 feature patterns exist, whatever the input's size,
and only those counts reach the driver.

Defined cases: a null text is empty; an empty text has no spans; null ids stay
null; repeated rows give one row each; no rows give no rows; without any
candidate no classifier is trained; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from babelcask.llm import tokens as T
from babelcask.llm.work import Staging

#: Base kinds in their order.
BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("account", "handle", "national_phone", "secret", "spelled_email")
KINDS = BASE_KINDS + MORE_KINDS

# ---- base patterns: fixed values ------------------------------------------------------------------

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is tried from its start only: a later start in it fails alike
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain: from each @, the run before it and the domain after it (linear time)."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        # an @ cannot be inside a domain, and a run ends at its @
        done = max(done, at + 1)
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in code points, by start, then kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    out.sort()
    return out


# ---- candidates beyond the base patterns -----------------------------------------------------------

_CANDIDATES = (
    ("spelled_email", re.compile(r"[A-Za-z0-9._-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(.] ?(?:dot)? ?[\])]? ?[A-Za-z]{2,12}){1,3}")),
    ("handle", re.compile(r"(?<![\w.%+-])@[A-Za-z0-9_]{3,30}(?![\w.])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*[0-9])[A-Za-z0-9_/+-]{20,}+")),
    ("national_phone", re.compile(r"(?<![0-9+])\(?[0-9]{2,5}\)?[ .-/][0-9]{3,4}[ .-][0-9]{3,5}(?![0-9])")),
    ("account", re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){8,33}(?![0-9])")),
)
_TRIGGER = re.compile(  # gazetteer of words that announce personal data
    r"(?i)\b(?:phone|tel|telephone|mobile|call|fax|email|e-mail|mail|contact|card|visa|iban|account|acct|token|secret|"
    r"password|passwd|pwd|api[_ -]?key|key|auth|bearer|ssn|passport|telefon|konto|karte|kennwort|passwort|correo|"
    r"teléfono|tarjeta|cuenta|clave|contraseña|courriel|téléphone|compte|carte|clé)\b")
_AGAINST = re.compile(  # gazetteer of words that announce other numbers
    r"(?i)\b(?:version|page|pages|isbn|issn|doi|chapter|figure|fig|table|year|sha|commit|build|rows?|lines?|total|sum|"
    r"seite|kapitel|página|capítulo|chapitre)\b")
_AROUND = 32


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * log2(c / n) for c in Counter(text).values())


def votes_and_features(text: str, kind: int, start: int, end: int) -> tuple[list[int], list[int]]:
    """Votes of the five labelers (1 yes, -1 no, 0 abstains) and the classifier's features (small numbers)."""
    said, before, after = text[start:end], text[max(0, start - _AROUND): start], text[end: end + 2]
    digits = _NOT_DIGIT.sub("", said)
    name = KINDS[kind]
    share = len(digits) / max(len(said), 1)
    strict = {"email": True, "ip": True, "card": True, "phone": True, "handle": any(c.isalpha() for c in said),
              "account": len(digits) in (9, 10, 11, 16), "national_phone": len(digits) in (9, 10, 11),
              "secret": bool(re.search("[A-Za-z]", said)) and len(set(said)) >= 10, "spelled_email": True}[name]
    trigger, against = bool(_TRIGGER.search(before)), bool(_AGAINST.search(before))
    quoted = before[-1:] in ("'", '"', "`") and after[:1] in ("'", '"', "`")
    assigned = bool(re.search(r"[=:]\s*[\"'`]?$", before))
    glued = before[-1:].isalnum() or after[:1].isalnum() or bool(re.match(r"[%€$£°]", after)) or before[-1:] in "$€£#/" and before != ""
    random_like = _entropy(said) >= 3.0 if name == "secret" else None
    votes = [
        1 if strict else -1,
        1 if trigger and not against else -1 if against and not trigger else 0,
        1 if assigned or quoted else -1 if glued else 0,
        0 if random_like is None else 1 if random_like else -1,
        (1 if luhn(digits) else -1) if name in ("card", "account") and 12 <= len(digits) <= 19 else 0,
    ]
    features = [
        kind, min(3, len(said) // 8), min(3, int(4 * share)), 1 + trigger - against,
        2 if assigned else 1 if quoted else 0, 2 if glued else 1 if before[-1:].isspace() or not before else 0,
        int(votes[4] > 0 or len(set(said)) >= 12),
    ]
    return votes, features


N_FEATURES = (len(KINDS), 4, 4, 3, 3, 3, 2)


def all_spans(text: str) -> list[tuple[int, int, int, list[int], list[int]]]:
    """Base spans, then candidates that overlap no base span: (kind, start, end, votes, features)."""
    base = base_spans(text)
    taken = [(s, e) for s, _, e in base]
    out = [(k, s, e) for s, k, e in base]
    for name, pattern in _CANDIDATES:
        kind = KINDS.index(name)
        for m in pattern.finditer(text):
            out.append((kind, m.start(), m.end()))
    taken.sort()
    starts = np.array([s for s, _ in taken], np.int64)
    reach = np.maximum.accumulate(np.array([e for _, e in taken], np.int64)) if taken else starts
    kept = []
    for i, (kind, s, e) in enumerate(out):
        if i >= len(base) and taken:
            j = int(np.searchsorted(starts, e)) - 1        # base spans that begin before the candidate's end
            if j >= 0 and reach[j] > s:
                continue
        kept.append((kind, s, e, *votes_and_features(text, kind, s, e)))
    return kept


# ---- one pass over the texts -------------------------------------------------------------------------

_SPANS = "array<struct<kind:int,start:int,end:int,votes:array<int>,features:array<int>>>"
_ROW = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([
    ("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
    ("votes", pa.list_(pa.int32())), ("features", pa.list_(pa.int32()))])))])
_SIGN = np.zeros(256, bool)
_SIGN[[*range(0x30, 0x3A), ord("@")]] = True


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("text")
        data, at = T.raw_bytes(column)
        # every kind but the spelled-out address holds a digit or an @
        marked = np.zeros(len(batch), bool)
        for lo in range(0, len(data), 1 << 22):
            hit = np.flatnonzero(_SIGN[data[lo: lo + (1 << 22)]]) + lo
            marked[np.searchsorted(at, hit, "right") - 1] = True
        spelled = pa.compute.match_substring_regex(column, r"[\[(] ?at ?[\])]").fill_null(False)
        marked |= spelled.to_numpy(zero_copy_only=False)
        spans = [[] for _ in range(len(batch))]
        for i in np.flatnonzero(marked):
            spans[i] = [dict(zip(("kind", "start", "end", "votes", "features"), s, strict=True))
                        for s in all_spans(column[int(i)].as_py() or "")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, _ROW.field("spans").type)], schema=_ROW)


# ---- estimation ---------------------------------------------------------------------------------------

def em(kinds: np.ndarray, votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(posterior per pattern, reliabilities [truth, labeler, vote + 1]) of the two-class labeler model.

    Labelers are independent given the truth; each kind has its own share of
    true spans.  Starts from the majority of the votes; one pseudo-count per cell.
    """
    posterior = np.clip(0.5 + votes.sum(1) / (2 * votes.shape[1]), 0.1, 0.9)
    table = None
    for _ in range(rounds):
        truth = np.stack([1 - posterior, posterior]) * counts
        table = np.ones((2, votes.shape[1], 3))
        for t in range(2):
            for v in range(3):
                table[t, :, v] += truth[t] @ (votes == v - 1)
        table /= table.sum(2, keepdims=True)
        prior = np.ones((int(kinds.max()) + 1, 2))
        np.add.at(prior, kinds, truth.T)
        prior /= prior.sum(1, keepdims=True)
        log = np.log(prior[kinds].T)
        for t in range(2):
            log[t] += np.log(table[t][np.arange(votes.shape[1]), votes + 1]).sum(1)
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(new - posterior).max() < 1e-9:
            posterior = new
            break
        posterior = new
    return posterior, table


def one_hot(features: np.ndarray) -> np.ndarray:
    return np.concatenate([np.eye(n)[features[:, i]] for i, n in enumerate(N_FEATURES)] + [np.ones((len(features), 1))], 1)


def fit_classifier(features: np.ndarray, counts: np.ndarray, positive: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic weights from counted feature patterns and their summed posteriors (Newton steps, ridge 1)."""
    x, weights = one_hot(features), None
    weights = np.zeros(x.shape[1])
    scale = counts.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = (x.T @ (counts * p - positive) + weights) / scale
        hessian = (x.T * (counts * p * (1 - p))) @ x / scale + np.eye(len(weights)) / scale
        step = np.linalg.solve(hessian, gradient)
        weights -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return weights


def train(found: DataFrame) -> np.ndarray | None:
    """Weights of the span classifier, from counted patterns only."""
    spans = found.select(F.explode("spans").alias("s")).select("s.*")
    patterns = (spans.groupBy("votes", "features").agg(F.count("*").alias("n"))).toPandas()
    if not len(patterns):
        return None
    features = np.array(patterns["features"].tolist(), np.int64)
    votes = np.array(patterns["votes"].tolist(), np.int64)
    counts = patterns["n"].to_numpy(float)
    posterior, _ = em(features[:, 0], votes, counts)
    return fit_classifier(features, counts, counts * posterior)


OUT = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_more long")


def chosen(found: list[dict], weights) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the candidates the classifier accepts; of overlapping ones the first, then the longest."""
    more = [s for s in found if s["kind"] >= len(BASE_KINDS)]
    if not more or weights is None:
        return []
    z = one_hot(np.array([s["features"] for s in more])) @ weights
    out, end = [], -1
    for s in sorted((s for s, v in zip(more, z, strict=True) if v >= 0),
                    key=lambda s: (s["start"], -s["end"], s["kind"])):
        if s["start"] >= end:
            out.append((s["start"], s["kind"], s["end"]))
            end = s["end"]
    return out


def _base_of(found: list[dict]) -> list[tuple[int, int, int]]:
    return [(s["start"], s["kind"], s["end"]) for s in found if s["kind"] < len(BASE_KINDS)]


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def _decide(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [([0] * 4, hashlib.sha256(b"").hexdigest(), "", 0)] * len(batch)
            spans = batch.column("spans")
            for i in np.flatnonzero(spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)):
                found = spans[int(i)].as_py()
                base, more = _base_of(found), chosen(found, weights)
                n = Counter(k for _, k, _ in base)
                rows[i] = ([n[k] for k in range(4)], hashlib.sha256(_said(base).encode()).hexdigest(),
                           _said(base + more), len(more))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array([r[0][k] for r in rows], pa.int64()) for k in range(4)],
                 pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()),
                 pa.array([r[3] for r in rows], pa.int64())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_more"])
    return run


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per document: counts, digest of the base spans, all spans as text."""
    stage = Staging(docs.sparkSession, "pii")
    found = stage.write(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                        .mapInArrow(_find, f"doc_id long, spans {_SPANS}"), "found")
    return found.mapInArrow(_decide(train(found)), OUT)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; a span inside an earlier one goes with it."""
    out, at = [], 0
    for a, kind, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def _redact(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = next(_find(iter([batch.select(["doc_id", "text"])]))).column("spans")
            text = batch.column("text").to_pylist()
            for i in np.flatnonzero(found.value_lengths().to_numpy(zero_copy_only=False)):
                spans = found[int(i)].as_py()
                text[i] = redacted(text[i], _base_of(spans) + chosen(spans, weights))
            column = pa.array(text, batch.schema.field("text").type)
            yield batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), column)
    return run


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the personal data of ``text`` replaced; every row and the other columns stay."""
    stage = Staging(docs.sparkSession, "pii")
    found = stage.write(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                        .mapInArrow(_find, f"doc_id long, spans {_SPANS}"), "found")
    return docs.mapInArrow(_redact(train(found)), docs.schema)
