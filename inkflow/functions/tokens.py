"""Word tokens as Column expressions.

A token is a word with the white space before it, so tokens joined give the text back but for white space at its end. A
tokenizer with a vocabulary would take the place of `tokens` and `count`, on which the other functions and the folds rest.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def last(text: Column, n: int) -> Column:
    """The last n tokens of a text; the whole text if it has no more."""
    if n <= 0:
        return F.lit("")
    return F.transform(F.array(tokens(text)), lambda own: F.when(F.size(own) <= n, text).otherwise(F.array_join(F.slice(own, -n, n), "")))[0]


def windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of `size` tokens, each starting size - overlap after the one before; the last may be overlap only."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be under the size")
    step = size - overlap

    def cut(own: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(own), F.lit(1)) - 1, F.lit(step))
        return F.when(F.size(own) <= size, F.array(text)).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(own, i + 1, F.lit(size)), "")))

    return F.transform(F.array(tokens(text)), cut)[0]
