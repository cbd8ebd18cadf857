"""Tokens of a byte-pair vocabulary: counts, windows and tails of texts.

A vocabulary is a file of ranks (a token's bytes in base64, and its rank) and a pattern that cuts a text into pieces. The
bytes of a piece are merged by the least rank first. `ends` gives the byte offsets where a text's tokens end, from which
windows and tails are cut as Column expressions, so a text is encoded once. Pieces repeat, so a task encodes each distinct one
once while it remembers it; nothing is shuffled, which for texts of any number is less work than joining pieces back.

Windows that cut a character hold the replacement character in its place, as the vocabulary's decoding has it.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

# Fixed value: the pattern that goes with the vocabulary of 50,256 tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Distinct pieces that a task remembers: so many of the last ones, and as many before that may come back.
REMEMBERED = 200_000
#: Bytes of a piece up to which its ranks are looked through anew for each merge.
SHORT = 64


def _merged_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As merged, by the least of a list of ranks, which for few bytes is sooner found than a heap is kept."""
    at, none = list(range(len(piece) + 1)), len(ranks) + 1_000_000_000
    pairs = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) < none:
        i = pairs.index(least)
        del at[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(piece[at[i] : at[i + 2]], none)
        if i:
            pairs[i - 1] = ranks.get(piece[at[i - 1] : at[i + 1]], none)
    return [b - a for a, b in pairwise(at)]


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The sizes of a piece's tokens: the neighbours of the least joint rank are merged, leftmost first, until none has one."""
    if piece in ranks:
        return [len(piece)]
    if len(piece) <= SHORT:
        return _merged_short(piece, ranks)
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n

    def offered(i: int) -> tuple[int, int, int] | None:
        j = after[i]
        if j >= n:
            return None
        rank = ranks.get(piece[i : after[j]])
        return None if rank is None else (rank, i, after[j])

    heap = [x for i in range(n) if (x := offered(i))]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        # the pair may have been merged into others since it was offered
        if not alive[i] or after[i] >= n or after[after[i]] != end:
            continue
        j = after[i]
        alive[j], after[i] = False, end
        if end < n:
            before[end] = i
        for k in (before[i], i):
            if k >= 0 and (x := offered(k)):
                heapq.heappush(heap, x)
    return [after[i] - i for i in range(n) if alive[i]]


class Encoder:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        # sizes as unsigned 16-bit numbers in bytes, which are small and joined at once
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def sizes(self, text: str) -> list[int]:
        """The bytes of each token."""
        return self._sizes(text).tolist()

    def ends(self, text: str) -> np.ndarray:
        return np.cumsum(self._sizes(text), dtype=np.int32)

    def _sizes(self, text: str) -> np.ndarray:
        pieces = self.pattern.findall(text)
        if len(self.known) > REMEMBERED:
            self.known, self.before = {}, self.known
        # a difference of the set and the dict's keys would go through all keys for each text
        for p in {p for p in pieces if p not in self.known}:
            self.known[p] = self.before.get(p) or np.array(merged(p.encode(), self.ranks), np.uint16).tobytes()
        return np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), np.uint16)


@lru_cache(2)
def encoder(path: str, pattern: str = PATTERN) -> Encoder:
    return Encoder(path, pattern)


def ends(text: Column, path: str, pattern: str = PATTERN) -> Column:
    """The byte offsets where the tokens of a text end; null for a null text."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def own(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ends = encoder(path, pattern).ends
        for texts in batches:
            yield texts.map(lambda t: None if t is None else ends(t))

    return own(text)


def count(text: Column, path: str, pattern: str = PATTERN) -> Column:
    return F.size(ends(text, path, pattern))


def cut(text: Column, stops: Column, start: Column, to: Column) -> Column:
    """The bytes of tokens start to `to` (exclusive) of a text."""
    first = F.when(start <= 0, 0).otherwise(F.get(stops, start - 1))
    return F.substring(F.encode(text, "UTF-8"), first + 1, F.get(stops, to - 1) - first)


def _cut(text: Column, stops: Column, start: Column, to: Column) -> Column:
    return F.make_valid_utf8(cut(text, stops, start, to).cast("string"))


def cuts(text: Column, stops: Column, starts: Column, size: int) -> Column:
    """The bytes of `size` tokens from each of starts. A text is encoded once for all of them, not for each, so that the work
    grows with its length and not with the square of it."""
    n = F.size(stops)

    def own(body: Column) -> Column:
        def part(i: Column) -> Column:
            first = F.when(i <= 0, 0).otherwise(F.get(stops, i - 1))
            return F.substring(body, first + 1, F.get(stops, F.least(i + size, n) - 1) - first)

        return F.transform(starts, part)

    # bound by a transform of one element
    return F.transform(F.array(F.encode(text, "UTF-8")), own)[0]


def windows(text: Column, stops: Column, size: int, overlap: int) -> Column:
    """Windows of `size` tokens, each starting size - overlap after the one before; the last may be overlap only. stops: `ends`."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be under the size")
    n = F.size(stops)
    starts = F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1, F.lit(size - overlap))
    return F.when(n <= size, F.array(text)).otherwise(F.transform(cuts(text, stops, starts, size), lambda x: F.make_valid_utf8(x.cast("string"))))


def last(text: Column, stops: Column, n: int) -> Column:
    """The last n tokens of a text; the whole text if it has no more."""
    if n <= 0:
        return F.lit("")
    return F.when(F.size(stops) <= n, text).otherwise(_cut(text, stops, F.size(stops) - n, F.size(stops)))
