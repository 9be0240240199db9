"""Score expressions.

Log probabilities are kept as integer micro-nats so that sums do not depend on
summation order: every engine and every partitioning gives the same scores.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICRO = 1_000_000.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micro_log(numerator, denominator) -> Column:
    """``round(ln(numerator / denominator) * 1e6)`` as BIGINT."""
    ratio = _col(numerator).cast("double") / _col(denominator).cast("double")
    return F.round(F.log(ratio) * F.lit(MICRO)).cast("bigint")


def argmax(scores) -> Column:
    """0-based index of the first maximum of an array."""
    s = _col(scores)
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def margin(scores, k) -> Column:
    """``s[k] - max(other s)``: ranking score of class ``k`` that does not grow with text length."""
    s = _col(scores)
    k = F.lit(k) if isinstance(k, int) else _col(k)
    others = F.filter(s, lambda x, i: i != k)
    return F.element_at(s, k + 1) - F.array_max(others)


def nll_micro(scores, y) -> Column:
    """Cross-entropy ``logsumexp(s) - s[y]`` of micro-nat scores, as integer micro-nats."""
    s = _col(scores)
    y = _col(y)
    top = F.array_max(s)
    total = F.aggregate(
        s, F.lit(0.0).cast("double"),
        lambda acc, x: acc + F.exp((x - top).cast("double") / F.lit(MICRO)),
    )
    lse = top.cast("double") / F.lit(MICRO) + F.log(total)
    return F.round((lse - F.element_at(s, y + 1).cast("double") / F.lit(MICRO)) * F.lit(MICRO)).cast("bigint")
