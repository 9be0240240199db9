"""Sorted keys and selects of the trie scores."""

import numpy as np

from babelcask.llm import trie_lm as L
from babelcask.llm.elias_fano import EliasFano


def test_select_finds_every_bit():
    rng = np.random.default_rng(3)
    for top in (10, 5_000, 2**40):
        values = np.sort(rng.integers(0, top, 3000).astype(np.uint64))
        ef = EliasFano.build(values)
        assert (ef.get(np.arange(3000)) == values).all()
        bits = np.unpackbits(ef.arrays["high"], bitorder="little")
        for one in (True, False):
            places = np.flatnonzero(bits == one)
            k = rng.integers(0, len(places), 500)
            assert (ef.select(k, one) == places[k]).all()


def test_joint_keys_keep_the_order():
    rng = np.random.default_rng(4)
    for top in (50, 2**40, 2**62):
        high, low = rng.integers(0, top, 2000), rng.integers(0, top, 2000)
        high[1000:], low[1000:] = high[:1000], low[:1000]
        key = L._joint(high, low)
        assert (key[:1000] == key[1000:]).all()
        assert (np.lexsort((np.arange(2000), low, high)) == np.lexsort((np.arange(2000), key))).all()


def test_distinct_keys():
    rng = np.random.default_rng(5)
    key, weight = rng.integers(0, 300, 5000), rng.integers(0, 3, 5000)
    first, number, total = L._distinct(key, weight)
    assert (key[first] == np.unique(key)).all() and (key[first][number] == key).all()
    assert (total == np.bincount(number, weights=weight)).all()
    assert [len(x) for x in L._distinct(key[:0], weight[:0])] == [0, 0, 0]
    order, edge = L._by_part(key, 300)
    assert (order == np.argsort(key, kind="stable")).all() and edge[-1] == 5000
