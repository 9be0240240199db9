"""Vectorised words of an Arrow column of texts.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``; UTF-8 continuation
bytes are never in that set, so bytes and code points agree on the borders.
Words become 64-bit hashes: position-weighted sums of random byte values,
finalised by a bit mixer.  All arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Texts are handled this many bytes at a time (a longer text alone).
CHUNK_BYTES = 2_000_000
#: Hashes are taken this many bytes at a time.
PIECE_BYTES = 1_000_000

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_STEP = U64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(29)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(32)
    return h


_powers = np.cumprod(np.full(64, _STEP, np.uint64))


def powers(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.cumprod(np.full(max(n, 2 * len(_powers)), _STEP, np.uint64))
    return _powers


def _word_hashes(data: np.ndarray, starts: np.ndarray, skip_punctuation: bool) -> np.ndarray:
    """Hashes of the words that begin at ``starts`` (the first at 0); what lies between words carries no weight."""
    dead = _SPACE[data]
    if skip_punctuation:
        dead |= _PUNCT[data]
    place = np.cumsum(~dead, dtype=np.int32)
    place -= np.repeat(place[starts], np.diff(np.append(starts, len(data))))
    place += 1
    place[dead] = 0
    value = powers(int(place.max()) + 1)[place]
    value *= _BYTE_VALUE[data]
    value[dead] = 0
    return mix(np.add.reduceat(value, starts))


@dataclass
class Words:
    """Words of some texts: ``rows`` are word offsets per text (texts + 1)."""

    data: np.ndarray      # bytes of the texts (lower-cased if asked)
    texts: np.ndarray     # byte offsets per text (texts + 1)
    starts: np.ndarray    # byte offset of each word
    ends: np.ndarray
    rows: np.ndarray

    def hashes(self, skip_punctuation: bool = False) -> np.ndarray:
        """64-bit hash per word; punctuation may carry no weight."""
        out, i, n = [np.zeros(0, np.uint64)], 0, len(self.starts)
        while i < n:      # some words at a time: byte-wise work needs some 40 bytes a byte
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + PIECE_BYTES, "right")))
            out.append(_word_hashes(self.data[self.starts[i]: self.ends[j - 1]], self.starts[i:j] - self.starts[i], skip_punctuation))
            i = j
        return np.concatenate(out)

    def owner(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0]: at[-1]], at - at[0]


def split_words(data: np.ndarray, texts: np.ndarray, lower: bool) -> Words:
    if lower:
        data = _LOWER[data]
    n = len(data)
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[texts] = True
    edge[1:] |= space
    start = ~space
    start[1:] &= edge[1:n]
    after = np.ones(n, bool)
    after[:-1] = space[1:]
    border = np.zeros(n + 1, bool)
    border[texts] = True
    after |= border[1:]
    start |= ~space & border[:n]
    starts = np.flatnonzero(start)
    ends = np.flatnonzero(~space & after) + 1
    return Words(data, texts, starts, ends, np.searchsorted(starts, texts))


def chunks(column: pa.Array, lower: bool, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first, last, Words) over runs of consecutive texts of about ``limit`` bytes."""
    data, texts = raw_bytes(column)
    i, n = 0, len(texts) - 1
    while i < n:
        j = int(np.searchsorted(texts, texts[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, split_words(data[texts[i]: texts[j]], texts[i: j + 1] - texts[i], lower)
        i = j


_GRAM = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)


def gram_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` words, over the whole array (borders not looked at)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n] * _GRAM[0]
    for k in range(1, width):
        total += words[k: k + n] * _GRAM[k]
    return mix(total)
