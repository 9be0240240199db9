"""Plain Python versions that the operators are held against."""

from __future__ import annotations

import collections
import re
import zlib

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def words(text, lower=True):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def shingles(text, width=4):
    w = words(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i: i + width]) for i in range(len(w) - width + 1)}


def near_duplicate_classes(docs):
    """[(doc_id, text)] with distinct ids -> {doc_id: (n_shingles, component_id)}."""
    sets = {d: shingles(t) for d, t in docs}
    inverted = {}
    for d, s in sets.items():
        for x in s:
            inverted.setdefault(x, []).append(d)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            root[d] = root[root[d]]
            d = root[d]
        return d

    for d, s in sets.items():
        near = {}
        for x in s:
            for e in inverted[x]:
                if e < d:
                    near[e] = near.get(e, 0) + 1
        for e, both in near.items():
            if 100 * both >= 80 * (len(s) + len(sets[e]) - both):
                x, y = find(d), find(e)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def spelling_variants(rows):
    """[(doc_id, text)] -> sorted [(word, form, root, n, n_near, form_n)]."""
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: set() for w in counts}
    wild = {}
    for w in counts:
        for i in range(len(w)):
            wild.setdefault((w[:i], w[i + 1:]), set()).add(w)
    for w in counts:
        for i in range(len(w)):
            near[w] |= wild[w[:i], w[i + 1:]]
            shorter = w[:i] + w[i + 1:]
            if shorter in counts:
                near[w].add(shorter)
                near[shorter].add(w)
        near[w].discard(w)
    form = {}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items())
