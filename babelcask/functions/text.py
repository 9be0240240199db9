"""Scalar text expressions (JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The strings that pandas' ``read_csv`` turns into nulls by
# default (its documented ``na_values`` list), in its own order.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Word boundary for the tokeniser: runs of blank, tab, carriage return, newline.
WORD_SPLIT = "[ \t\r\n]+"

# Fixed value: the separator the cascade puts between language and text.
SEPARATOR = " </s> "


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_na(c) -> Column:
    """Null for a field whose whole value is one of the null tokens; no trimming."""
    c = _col(c)
    return F.when(c.isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(c)


def words(text) -> Column:
    """Lower-cased words of the whole text, empty pieces removed."""
    return F.filter(F.split(F.lower(_col(text)), WORD_SPLIT), lambda w: w != F.lit(""))


def truncate(tokens, max_tokens: int) -> Column:
    """First ``max_tokens`` tokens (the model input limit of the tokeniser)."""
    return F.slice(_col(tokens), 1, max_tokens)


def prefixed(language, text, separator: str = SEPARATOR) -> Column:
    """``language + separator + text``; null if either side is null."""
    return F.concat(_col(language), F.lit(separator), _col(text))


def padded(word) -> Column:
    """Word with boundary marks, so grams know where a word starts and ends."""
    return F.concat(F.lit("<"), _col(word), F.lit(">"))
