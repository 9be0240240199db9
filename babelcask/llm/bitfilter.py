"""A membership filter of a fixed size: no false negatives, whatever the number of keys.

Two of 2**26 bits per 64-bit key.  Spark gathers the set bits as at most 2**20
longs (8 MB), so the size handed to tasks does not depend on the data; with
very many keys the filter only lets more rows through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 26


def make_filter(keys: DataFrame) -> np.ndarray:
    """``keys``: one long column of well-mixed 64-bit hashes."""
    key = F.col(keys.columns[0])
    places = keys.select(F.explode(F.array(
        F.shiftrightunsigned(key, 64 - BITS), key.bitwiseAND(F.lit(2**BITS - 1)))).alias("bit"))
    slots = (places.groupBy(F.shiftright("bit", 6).alias("slot"))
             .agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("bits")))
    rows = slots.toArrow()
    out = np.zeros(2**BITS // 64, np.uint64)
    if rows.num_rows:
        out[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def passing(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Numbers of the keys that the filter lets through."""
    def has(place):
        return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0
    at = np.flatnonzero(has(keys >> np.uint64(64 - BITS)))
    return at[has(keys[at] & np.uint64(2**BITS - 1))]
