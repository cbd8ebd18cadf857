"""Helpers shared by the training-data operators.

Texts reach Python in Arrow batches; these helpers cut batches into slices of bounded bytes, expose a text column as
one byte buffer, and find and hash words in it with numpy.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than these six, in every operator of this package.
WORD = r"[^\x20\x09-\x0D]+"
NOT_WORD = r"[\x20\x09-\x0D]+"

#: Bytes of text that one numpy pass works on; it bounds a worker's memory (a longer document is a pass of its own).
SLICE_BYTES = 3 << 20

#: Stands for a null doc_id where ids are compared or joined: it comes after all others.
NO_ID = (1 << 63) - 1

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """Use the cluster's shared checkpoint folder; only a local session that names none gets a folder of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(folder)
    return spark


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame, *more: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The columns an operator works on, under names of its own: _id (null: NO_ID), _text (null: empty)."""
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), *more)


def packed_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """_id (null: NO_ID) and _row, a struct of all columns of docs, whatever their names."""
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("_id"), F.struct("*").alias("_row"))


def packed_texts(docs: DataFrame) -> DataFrame:
    """As packed_rows, with _hash of the text: rows are told apart by both where a doc_id is repeated or null."""
    return packed_rows(docs).withColumn("_hash", F.xxhash64(F.coalesce("_row.text", F.lit(""))))


def anew(key: str):
    """A join key equal to a long column one to one. Spark splits a skewed partition only of a join that both sides are
    dealt out for, so an aggregate that is dealt by the column itself is joined by this."""
    return F.col(key).bitwiseXOR(F.lit(1).cast("long"))


def original_id(name: str = "doc_id"):
    return F.when(F.col("_id") != NO_ID, F.col("_id")).alias(name)


def slices(batches: Iterator[pa.RecordBatch], column: str = "_text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into consecutive slices whose column holds at most `limit` bytes, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < n:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    column = pc.fill_null(column, "") if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pc.fill_null(column, b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return buf, off - off[0]


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each word, words never crossing texts."""
    n = len(buf)
    if not n:
        return (np.empty(0, np.int64),) * 3
    word = ~_SPACE[buf]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    after[-1], after[:-1] = False, word[1:]
    before[off[:-1][off[:-1] < n]] = False
    after[off[1:][off[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PRIME = np.uint64((1 << 31) - 1)
_BITS = np.uint64(31)


def _fold(x: np.ndarray) -> np.ndarray:
    """A number congruent to x modulo the prime 2^31 - 1 and under 2^33 + 2^31."""
    return (x & _PRIME) + (x >> _BITS)


def _rest(x: np.ndarray) -> np.ndarray:
    """x modulo the prime."""
    x = _fold(_fold(x))
    return np.minimum(x, x - _PRIME)


class SpanHash:
    """62-bit hashes of arbitrary spans of a byte buffer: two polynomials modulo the prime 2^31 - 1, at bases of their own.

    The bases are drawn from the seed; two strings of n symbols meet in both with a probability of (n / 2^31)^2 over the
    bases. Prefix sums are exact integers, congruent to the polynomials; they hold up to 2^30 symbols.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        prime = int(_PRIME)
        self.value = rng.integers(1, prime, (2, 256), dtype=np.uint64)
        self.bases = [int(rng.integers(1 << 30, prime - 1)) for _ in range(2)]
        self.inverse = [pow(b, -1, prime) for b in self.bases]
        self.powers = [np.ones(1, np.uint64) for _ in range(2)]
        self.inverses = [np.ones(1, np.uint64) for _ in range(2)]

    def _grow(self, n: int) -> None:
        """Powers of the bases and of their inverses up to n: a span's hash must not depend on where the span lies."""
        while len(self.powers[0]) <= n:
            m = len(self.powers[0])
            for lane in range(2):
                for table, base in ((self.powers, self.bases[lane]), (self.inverses, self.inverse[lane])):
                    table[lane] = np.concatenate([table[lane], _rest(table[lane] * np.uint64(pow(base, m, int(_PRIME))))])

    def sums(self, buf: np.ndarray) -> np.ndarray:
        return self._sums([v[buf] for v in self.value])

    def sums_of(self, values: np.ndarray) -> np.ndarray:
        """As sums, for symbols given as well-mixed 64-bit values."""
        return self._sums([values >> np.uint64(33), values & _PRIME])

    def _sums(self, lanes: list[np.ndarray]) -> np.ndarray:
        n = len(lanes[0])
        self._grow(n)
        out = np.zeros((2, n + 1), np.uint64)
        for lane, values in enumerate(lanes):
            np.cumsum(_fold(values * self.powers[lane][:n]), out=out[lane, 1:])
        return out

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        one, two = (_rest(_rest(sums[lane][ends] - sums[lane][starts]) * self.inverses[lane][starts]) for lane in range(2))
        return mix((one << np.uint64(32)) | two)


#: Words of more bytes are hashed one by one.
_LONG_WORD = 64
_STEPS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word: eight bytes at a time, each step a bijection of the eight bytes."""
    size = ends - starts
    one, two = size.astype(np.uint64) * _STEPS[1], size.astype(np.uint64) * _STEPS[0]
    if not len(size):
        return one, two
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    some = np.flatnonzero(size <= _LONG_WORD)
    at = 0
    while len(some):
        left = np.minimum(size[some] - at, 8).astype(np.uint64)
        value = eights[starts[some] + at] & (np.uint64((1 << 64) - 1) >> (np.uint64(64) - left * np.uint64(8)))
        one[some] = mix(one[some] * _STEPS[0] + value)
        two[some] = mix((two[some] ^ value) * _STEPS[1] + np.uint64(at + 1))
        at += 8
        some = some[size[some] > at]
    for k in np.flatnonzero(size > _LONG_WORD).tolist():
        whole = xxhash.xxh3_128_intdigest(buf[starts[k] : ends[k]])
        one[k], two[k] = whole >> 64, whole & ((1 << 64) - 1)
    return one, two


def ngram_hash(words: np.ndarray, n: int, odd: int) -> np.ndarray:
    """A hash of each n consecutive word hashes; one value for each start that has n words after it."""
    m = max(0, len(words) - n + 1)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = out * np.uint64(odd) + words[j : j + m]
    return mix(out)


def gather(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans of a buffer one after another, and their offsets."""
    sizes = ends - starts
    off = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=off[1:])
    if not off[-1]:
        return np.empty(0, np.uint8), off
    return buf[np.repeat(starts - off[:-1], sizes) + np.arange(off[-1])], off


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, least: int = 20_000) -> Iterator[pa.Table]:
    """Tables of complete groups from a stream that is sorted by `key`, several groups at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        keys = batch.column(key)
        if rows < least or len(held) > 1 and held[-2].column(key)[-1] == keys[-1] and keys[0] == keys[-1]:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        k = table.column(key).to_numpy()
        cut = int(np.flatnonzero(k == k[-1])[0])
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        rows = table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def flat(column) -> pa.Array:
    """A table's column as one array."""
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) and column.num_chunks != 1 else column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
