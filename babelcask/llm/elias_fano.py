"""Elias-Fano sequences and a two-level n-gram trie over them, in one memory-mapped file.

A monotone sequence keeps the low bits of its values side by side and the high
parts in unary.  ``select`` finds the k-th set (or clear) bit by a binary search
over the counts of set bits before every 64; ``successor`` finds the first value >= x by the bucket of its high
part and a binary search on low bits.  All queries take arrays.
"""

from __future__ import annotations

import tempfile

import numpy as np

U64 = np.uint64
#: Pairs that are looked up at a time.
QUERIES = 1 << 18
_POP = np.array([bin(i).count("1") for i in range(256)], np.int64)
# place of the k-th set bit in a byte (bits counted from the low end)
_PLACE = np.zeros((256, 8), np.int64)
for _b in range(256):
    for _k, _p in enumerate([i for i in range(8) if _b >> i & 1]):
        _PLACE[_b, _k] = _p


class EliasFano:
    """``arrays`` holds everything that is kept; the rest are numbers."""

    def __init__(self, n: int, low_bits: int, arrays: dict[str, np.ndarray]):
        self.n, self.low_bits, self.arrays = n, low_bits, arrays

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        """``values``: non-decreasing uint64."""
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        high = (values >> U64(low_bits)).astype(np.int64)
        bits = np.zeros(n + (int(high[-1]) if n else 0) + 1, np.uint8)
        bits[high + np.arange(n)] = 1
        low = [np.zeros(0, np.uint8)]
        for lo in range(0, n, 1 << 16):        # a multiple of 8 values: the pieces meet at whole bytes
            part = values[lo: lo + (1 << 16)]
            low.append(np.packbits(((part[:, None] >> np.arange(low_bits, dtype=np.uint64)) & U64(1)).astype(np.uint8).ravel(),
                                   bitorder="little"))
        packed = np.packbits(bits, bitorder="little")
        packed = np.append(packed, np.zeros(-len(packed) % 8, np.uint8))
        before = np.concatenate([[0], np.cumsum(_POP[packed].reshape(-1, 8).sum(1))])
        arrays = {"low": np.append(np.concatenate(low), np.zeros(9, np.uint8)), "high": packed,
                  "ones": before[:-1].astype(np.uint32)}
        return cls(n, low_bits, arrays)

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Place of the k-th (from 0) set or clear bit."""
        before = np.asarray(self.arrays["ones"], np.int64)
        if not one:
            before = 64 * np.arange(len(before)) - before
        at = np.searchsorted(before, k, "right") - 1
        left = (k - before[at]).astype(np.uint8)
        word = np.asarray(self.arrays["high"]).view(np.uint64)[at]
        if not one:
            word = ~word
        place = at * 64
        for half in (32, 16, 8):                 # the half of the word that holds the bit
            here = np.bitwise_count(word & U64((1 << half) - 1))
            up = left >= here
            left -= here * up
            word >>= up.astype(np.uint64) * U64(half)
            place += half * up
        return place + _PLACE[(word & U64(255)).astype(np.int64), left]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.int64) * self.low_bits
        byte, low = at >> 3, self.arrays["low"]
        word = np.zeros(len(i), np.uint64)
        for k in range((self.low_bits + 7) // 8 + 1):
            if k < 8:
                word |= low[byte + k].astype(np.uint64) << U64(8 * k)
        word >>= (at & 7).astype(np.uint64)
        if self.low_bits > 57:
            word |= np.where(at & 7, low[byte + 8].astype(np.uint64) << (U64(64) - (at & 7).astype(np.uint64)), U64(0))
        return word & U64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        high = (self.select(i, True) - i).astype(np.uint64)
        return high << U64(self.low_bits) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first value >= x, n if none; whether it equals x)."""
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        x = np.asarray(x, np.uint64)
        h = (x >> U64(self.low_bits)).astype(np.int64)
        low = x & U64((1 << self.low_bits) - 1)
        buckets = int(self.select(np.array([self.n - 1]), True)[0]) - (self.n - 1)   # high part of the last value
        inside = h <= buckets
        a = np.full(len(x), self.n, np.int64)
        b = a.copy()
        at = np.flatnonzero(inside)
        hk = h[at]
        first = np.zeros(len(at), np.int64)
        later = np.flatnonzero(hk > 0)
        first[later] = self.select(hk[later] - 1, False) - (hk[later] - 1)
        end = np.full(len(at), self.n, np.int64)
        closed = np.flatnonzero(hk < buckets)
        end[closed] = self.select(hk[closed], False) - hk[closed]
        a[at], b[at] = first, end
        lo, hi = a.copy(), b.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < low[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        same = lo < b
        same[same] = self._low(lo[same]) == low[same]
        return lo, same & inside

    def bytes(self) -> int:
        return sum(a.nbytes for a in self.arrays.values())


class Trie:
    """Contexts (level 1), pointers, and their successors (level 2), with a quantised value each.

    Successors of a context follow each other in order; each range is raised
    by the last value of the range before, which makes the level monotone.
    """

    def __init__(self, contexts: np.ndarray, successors: np.ndarray, context_values: np.ndarray, values: np.ndarray):
        """Pairs sorted by (context, successor), distinct; ``context_values`` per distinct context, in order."""
        new = np.concatenate([[True], contexts[1:] != contexts[:-1]]) if len(contexts) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        range_max = np.append(successors[begin[1:] - 1], successors[-1:]) + 1 if len(begin) else successors
        base = np.cumsum(range_max) - range_max
        raised = successors + 1 + np.repeat(base, np.diff(np.append(begin, len(contexts))))
        self.contexts = EliasFano.build(contexts[begin].astype(np.uint64))
        self.pointers = EliasFano.build(np.append(begin, len(contexts)).astype(np.uint64))
        self.level = EliasFano.build(raised.astype(np.uint64))
        self.context_values, self.values = context_values.astype(np.uint16), values.astype(np.uint16)
        self._map()

    def _map(self) -> None:
        """Moves every array to a file without a name that is mapped into memory; it goes with the trie."""
        with tempfile.TemporaryFile() as file:
            parts = [(s.arrays, name) for s in (self.contexts, self.pointers, self.level) for name in s.arrays]
            parts += [(self.__dict__, "context_values"), (self.__dict__, "values")]
            places, at = [], 0
            for owner, name in parts:
                array = np.ascontiguousarray(owner[name])
                file.seek(at)
                file.write(array.tobytes())
                places.append((owner, name, array.dtype, len(array), at))
                at += -(-array.nbytes // 64) * 64
            file.write(b"\0")
            file.flush()
            for owner, name, dtype, n, place in places:
                owner[name] = np.memmap(file, dtype, "r", place, (n,)) if n else np.zeros(0, dtype)

    def find(self, contexts: np.ndarray, successors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value of the pair or -1, value of the context or -1); ``contexts`` in runs of equal ones."""
        pair = np.full(len(contexts), -1, np.int32)
        context = pair.copy()
        if self.contexts.n:
            for lo in range(0, len(contexts), QUERIES):       # a query's steps need some 100 bytes
                some = slice(lo, lo + QUERIES)
                self._find(contexts[some], successors[some], pair[some], context[some])
        return pair, context

    def _find(self, contexts: np.ndarray, successors: np.ndarray, pair: np.ndarray, context: np.ndarray) -> None:
        new = np.concatenate([[True], contexts[1:] != contexts[:-1]])
        run = np.cumsum(new) - 1
        at, known = self.contexts.successor(contexts[new].astype(np.uint64))
        at = np.where(known, at, 0)
        lo, hi = self.pointers.get(at).astype(np.int64), self.pointers.get(at + 1).astype(np.int64)
        base = np.where(lo > 0, self.level.get(np.maximum(lo - 1, 0)), 0).astype(np.int64)
        ours = np.flatnonzero(known[run])
        r = run[ours]
        place, same = self.level.successor((base[r] + successors[ours] + 1).astype(np.uint64))
        same &= (place >= lo[r]) & (place < hi[r])
        pair[ours[same]] = self.values[place[same]]
        context[ours] = self.context_values[at[r]]

    def bytes(self) -> int:
        return sum(s.bytes() for s in (self.contexts, self.pointers, self.level)) + self.context_values.nbytes + self.values.nbytes
