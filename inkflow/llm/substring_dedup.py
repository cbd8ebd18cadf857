"""Substring dedup by super-k-mers (operator 4).

A window is `window` consecutive words. The minimiser of a window is the least hash of its `gram`-word grams, so equal
windows have equal minimisers. Consecutive windows of a text that share a minimiser form a super-k-mer and travel as
one packed string to the minimiser's bucket; in the bucket the window hashes are sorted, and each window is held word for
word against the one of the least document of its group. A word goes if a window over it also starts in a document of a
smaller id.

Windows are first counted by cells of minimisers (one number for each cell and task). A cell of more windows than a
bucket's share is hot: its windows leave the buckets and become rows of their own, dealt out by a 128-bit hash, whose
least documents are partial aggregates that are joined back, so that Spark may split even a passage that a third of all
documents hold. A bucket so never holds more than a few shares, whatever the minimiser.

Shuffled: the super-k-mers (about 2.8 times the words, compressed with zstd in each map task, where equal strings lie
side by side, so that a passage which many documents share costs little more than its occurrences), 40 bytes for each
window of a hot cell, and the texts once. A bucket holds its super-k-mers and 28 bytes for each window.

Defined results: a null text has no words; texts under `window` words lose nothing; rows that repeat a doc_id do not
take words from each other; a null doc_id comes after all others; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 13
GRAM = 2
#: Buckets for each shuffle partition; a bucket is what one numpy sort works on.
BUCKETS = 4
#: Cells that the windows of a bucket are counted by.
CELLS = 4
#: Windows of a cell beyond which it may be hot; it is if it holds more than a bucket's share of all windows, too.
HOT = 50_000

#: Null doc_ids stand from here on, told apart by their texts; all of them come last and none before another.
_NULLS = C.NO_ID - (1 << 31)


def _source(docs: DataFrame) -> DataFrame:
    """doc_id, _id, _text and _hash: rows are told apart by _id and 32 bits of the text's hash, null ids by 63 bits."""
    full = C.texts(docs, F.col("doc_id")).withColumn("_full", F.xxhash64("_text"))
    own = F.when(F.col("doc_id").isNull(), F.lit(_NULLS).cast("long") + F.shiftrightunsigned("_full", 33)).otherwise(F.col("_id"))
    return full.select("doc_id", own.alias("_id"), F.col("_full").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).alias("_hash"), "_text")


def _minimisers(grams: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    out, have = grams, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


class _Slice:
    """The windows of a slice of texts: first word and minimiser's cell of each, and the words."""

    def __init__(self, batch: pa.RecordBatch, window: int, gram: int, cells: int):
        self.ids, self.text_hash = batch.column("_id").to_numpy(), batch.column("_hash").to_numpy()
        self.buf, self.off = C.buffer_of(batch.column("_text"))
        self.starts, self.ends, self.doc = C.word_spans(self.buf, self.off)
        n = max(0, len(self.starts) - window + 1)
        self.at = np.flatnonzero(self.doc[:n] == self.doc[window - 1 :]) if n else np.empty(0, np.int64)
        self.first_word = np.searchsorted(self.starts, self.off[:-1])
        if len(self.at):
            self.hashes = C.word_hashes(self.buf, self.starts, self.ends)
            self.key = _minimisers(C.ngram_hash(self.hashes[0], gram, _ODD[0]), window - gram + 1)[self.at]
            self.cell = (C.mix(self.key) % np.uint64(cells)).astype(np.int64)


_ODD = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _window_hashes(hashes: tuple[np.ndarray, np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray]:
    return C.ngram_hash(hashes[0], window, _ODD[1]), C.ngram_hash(hashes[1], window, _ODD[0])


def count_cells(batches: Iterator[pa.RecordBatch], window: int, gram: int, cells: int) -> Iterator[pa.RecordBatch]:
    """One row (cell, n) for each cell that has windows in this task."""
    count = np.zeros(cells, np.int64)
    for batch in C.slices(batches):
        x = _Slice(batch, window, gram, cells)
        if len(x.at):
            count += np.bincount(x.cell, minlength=cells)
    some = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], ["cell", "n"])


def hot_windows(batches: Iterator[pa.RecordBatch], window: int, gram: int, cells: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (one, two, _id, _hash, place) of the windows of hot cells."""
    for batch in C.slices(batches, limit=1 << 20):
        x = _Slice(batch, window, gram, cells)
        some = np.flatnonzero(np.isin(x.cell, hot)) if len(x.at) else x.at
        if len(some):
            at = x.at[some]
            one, two = _window_hashes(x.hashes, window)
            doc = x.doc[at]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (one[at].view(np.int64), two[at].view(np.int64), x.ids[doc], x.text_hash[doc], at - x.first_word[doc])], ["one", "two", "_id", "_hash", "place"])


def super_kmers(batches: Iterator[pa.RecordBatch], window: int, gram: int, buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of (bucket, packed super-k-mers) from rows of (_id, _hash, _text), without those of hot cells."""
    pack = zstandard.ZstdCompressor(level=6)
    for batch in C.slices(batches):
        x = _Slice(batch, window, gram, buckets * CELLS)
        if not len(x.at):
            continue
        at, key, cell = x.at, x.key, x.cell
        if len(hot):
            cold = ~np.isin(cell, hot)
            at, key, cell = at[cold], key[cold], cell[cold]
            if not len(at):
                continue
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (key[1:] != key[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        key, bucket, first, last = key[first], (cell[first] % buckets).astype(np.int32), at[first], at[last] + window - 1
        order = np.lexsort((key, bucket))
        bucket, first, last = bucket[order], first[order], last[order]
        data, at_byte = C.gather(x.buf, x.starts[first], x.ends[last])
        cuts = np.concatenate([np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1)), [len(bucket)]])
        own, place = x.doc[first], first - x.first_word[x.doc[first]]
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            head = np.array([b - a], np.int64).tobytes() + x.ids[own[a:b]].tobytes() + b"".join(v.astype(np.uint32).tobytes() for v in (x.text_hash[own[a:b]], place[a:b], np.diff(at_byte[a : b + 1])))
            rows.append(pack.compress(head + data[at_byte[a] : at_byte[b]].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array(rows, pa.binary())], ["bucket", "packed"])


def _unpacked(packed: bytes):
    """ids, text hashes, places, sizes and bytes of a pack's super-k-mers."""
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    text_hash, place, sizes = np.frombuffer(raw, np.uint32, 3 * n, 8 + 8 * n).reshape(3, n).astype(np.int64)
    return np.frombuffer(raw, np.int64, n, 8), text_hash, place, sizes, np.frombuffer(raw, np.uint8, offset=8 + 20 * n)


def same_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a and b of a buffer are equal byte for byte."""
    size = ends - starts
    out = size[a] == size[b]
    eights = np.ndarray((len(buf) + 1,), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))
    alive, at = np.flatnonzero(out), 0
    while len(alive):
        left = np.minimum(size[a[alive]] - at, 8).astype(np.uint64)
        differ = eights[starts[a[alive]] + at] ^ eights[starts[b[alive]] + at]
        equal = (differ << (np.uint64(64) - left * np.uint64(8))) == 0
        out[alive[~equal]] = False
        at += 8
        alive = alive[equal]
        alive = alive[size[a[alive]] > at]
        if at > 256 and len(alive) < 64:  # a few very long words
            for k in alive.tolist():
                out[k] = np.array_equal(buf[starts[a[k]] : ends[a[k]]], buf[starts[b[k]] : ends[b[k]]])
            break
    return out


def _later(one: np.ndarray, two: np.ndarray, ids: np.ndarray, at: np.ndarray, words, window: int) -> np.ndarray:
    """For each window, whether an equal one is in a document of a smaller id. at: its first word.

    Windows are sorted by their hashes; each is then held word for word against the one of the least id of its group.
    """
    order = np.lexsort((ids, two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    group = np.cumsum(new) - 1
    leader = np.empty(len(order), np.int64)
    leader[order] = order[np.flatnonzero(new)][group]
    out = ids > ids[leader]
    some = np.flatnonzero(out)
    if not len(some):
        return out
    mine, its = at[some], at[leader[some]]
    follows = np.append(False, (mine[1:] == mine[:-1] + 1) & (its[1:] == its[:-1] + 1))
    whole = np.flatnonzero(~follows)
    a = np.concatenate([(mine[whole][:, None] + np.arange(window)).ravel(), mine[follows] + window - 1])
    b = np.concatenate([(its[whole][:, None] + np.arange(window)).ravel(), its[follows] + window - 1])
    if not same_words(*words, a, b).all():
        buf, starts, ends = words
        least: dict[tuple, int] = {}
        exact = np.empty(len(ids), bool)
        keys = [tuple(buf[starts[k] : ends[k]].tobytes() for k in range(p, p + window)) for p in at.tolist()]
        for key, i in zip(keys, ids.tolist(), strict=True):
            least[key] = min(least.get(key, i), i)
        exact[:] = [i > least[key] for key, i in zip(keys, ids.tolist(), strict=True)]
        return exact
    return out


def repeated_runs(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows of (_id, _hash, first word, end) that go, from rows of (bucket, packed) sorted by bucket."""
    for table in C.whole_groups(batches, "bucket", 1):
        buckets = table.column("bucket").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(buckets)) + 1, [len(buckets)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            ids, text_hash, place, sizes, buf = (np.concatenate(v) for v in zip(*(_unpacked(v.as_py()) for v in table.column("packed").slice(a, b - a)), strict=True))
            off = np.append(0, np.cumsum(sizes))
            starts, ends, run = C.word_spans(buf, off)
            at = np.flatnonzero(run[: max(0, len(run) - window + 1)] == run[window - 1 :])
            own = run[at]
            ids, text_hash, place = ids[own], text_hash[own], place[own] + at - np.searchsorted(starts, off[:-1])[own]
            del run, own
            one, two = (h[at] for h in _window_hashes(C.word_hashes(buf, starts, ends), window))
            gone = np.flatnonzero(_later(one, two, np.minimum(ids, _NULLS), at, (buf, starts, ends), window))
            del one, two
            if not len(gone):
                continue
            ids, text_hash, place = ids[gone], text_hash[gone], place[gone]
            new = np.ones(len(gone), bool)
            new[1:] = (ids[1:] != ids[:-1]) | (text_hash[1:] != text_hash[:-1]) | (place[1:] != place[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(gone)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[first], text_hash[first], place[first], place[last] + window)], ["_id", "_hash", "first", "end"])


def hot_cells(source: DataFrame, window: int, gram: int, buckets: int, hot: int) -> np.ndarray:
    """Cells with more than `hot` windows and a bucket's share of all: under `buckets` numbers, whatever the input."""
    counted = source.mapInArrow(lambda it: count_cells(it, window, gram, buckets * CELLS), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).checkpoint()
    total = counted.agg(F.sum("n")).first()[0] or 0
    return np.array(sorted(r.cell for r in counted.filter(F.col("n") > max(hot, total // buckets)).select("cell").collect()), np.int64)


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, buckets: int | None = None, hot: int = HOT) -> DataFrame:
    """(_id, _hash, first, end): spans of words that also start in a document of a smaller id. Spans may overlap."""
    C.with_checkpoints(docs.sparkSession)
    n = C.shuffle_partitions(docs.sparkSession)
    buckets = buckets or n * BUCKETS
    source = _source(docs).drop("doc_id")
    cells = hot_cells(source, window, gram, buckets, hot)
    kmers = source.mapInArrow(lambda it: super_kmers(it, window, gram, buckets, cells), "bucket int, packed binary")
    out = kmers.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: repeated_runs(it, window), "_id long, _hash long, first long, end long")
    if len(cells):
        own = source.mapInArrow(lambda it: hot_windows(it, window, gram, buckets * CELLS, cells), "one long, two long, _id long, _hash long, place long")
        clipped = F.least(F.col("_id"), F.lit(_NULLS).cast("long"))
        least = own.groupBy("one", "two").agg(F.min(clipped).alias("least"), F.max(clipped).alias("most")).filter("least < most").select(C.anew("one").alias("key"), "two", "least")
        gone = own.withColumn("key", C.anew("one")).join(least, ["key", "two"]).filter(clipped > F.col("least"))
        out = out.unionByName(gone.select("_id", "_hash", F.col("place").alias("first"), (F.col("place") + window).alias("end")))
    return out


def _remove(batches: Iterator[pa.RecordBatch], sep: bytes) -> Iterator[pa.RecordBatch]:
    for batch in C.slices(batches):
        out = []
        for text, spans in zip(batch.column("_text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words = text.encode().split()
            n = len(words)
            if spans:
                keep = np.ones(n, bool)
                for x in spans:
                    keep[x["first"] : x["end"]] = False
                words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            out.append((n, n - len(words), sep.join(words).decode()))
        n_words, gone, kept = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(n_words, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["_key", "n_words", "n_removed", "kept"])


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    spans = repeated_spans(docs, window, gram).groupBy("_id", "_hash").agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    joined = _source(docs).join(spans, ["_id", "_hash"], "left").select(F.col("doc_id").cast("long").alias("_key"), "_text", "spans")
    out = joined.mapInArrow(lambda it: _remove(it, b" "), "_key long, n_words long, n_removed long, kept string")
    return out.select(F.col("_key").alias("doc_id"), "n_words", "n_removed", "kept")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
