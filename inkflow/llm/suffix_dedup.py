"""Suffix-array dedup of bytes (operator 2).

A byte goes if a string of `length` bytes over it also starts at another place of any document, the same one included.

1. Windows are grouped by an anchor: the least of the hashes of the first SPAN 16-byte grams, so equal windows have
   equal anchors at equal offsets, and consecutive windows that share an anchor form a run. Every window of a run holds the
   length - SPAN + 1 bytes from its anchor (its core). A core that occurs once rules its run out; runs with equal
   strings repeat as a whole (strings are equal if two hashes of 62 bits with bases of their own are). What is left are
   the runs at the borders of repeats.
2. Those strings, one for each class of equal ones, go to the bucket of their core, and each bucket's suffixes are sorted
   by the difference-cover algorithm (mod 3): the sampled suffixes' leading symbols are sorted and named, names are
   recursed on, the remaining suffixes are sorted by one symbol and the rank that follows, and both are merged. Adjacent
   suffixes are then compared over `length` bytes.

Suffix arrays are built bucket by bucket because equal windows share a bucket, so no order across buckets is needed: the
sort of all suffixes of the corpus, 860 million rows for 0.5 GB of documents, would shuffle several times the budget.
Cores and classes are counted by partial aggregates and joined back, so Spark may split a core that very many documents
hold. A core of over HOT_CLASSES different strings has no bucket: its windows are dealt out by two 64-bit hashes each,
and those are counted. A batch of buckets over HOT_BYTES is settled by such hashes where it lies.

Shuffled: 16 bytes for each run's core (one run in about SPAN / 2 bytes), 56 for the run, border strings, the texts once.

Defined results: a null text is empty; a text under `length` bytes loses nothing; rows that repeat a document repeat
its strings, so they lose them; a null doc_id is a document like any other; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH = 400
SPAN = 128
GRAM = 16
SLICE = 1 << 20
#: Bytes of buckets that one suffix array is built over, and the size beyond which a single bucket is hashed.
BATCH_BYTES = 1 << 20
HOT_BYTES = 8 << 20
#: Different strings of one core beyond which they are not gathered in a bucket.
HOT_CLASSES = 8_192

_STRINGS, _MORE = C.SpanHash(12), C.SpanHash(13)


def _packed(columns: list[np.ndarray], bounds: list[int]) -> np.ndarray:
    """Columns of symbols as one array of integers in the same lexicographic order."""
    out, bound = columns[0].astype(np.int64), bounds[0]
    for c, b in zip(columns[1:], bounds[1:], strict=True):
        if bound * b >= 1 << 62:
            values, out = np.unique(out, return_inverse=True)
            bound = len(values)
        out, bound = out * b + c, bound * b
    return out


def suffix_array(symbols: np.ndarray, leading: int = 3) -> np.ndarray:
    """Starts of the suffixes of an array of positive integers in lexicographic order, by a difference cover mod 3.

    leading: symbols by which sampled suffixes are sorted at first; any number from 3 on gives the same array.
    """
    n = len(symbols)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), np.int64)
    bound = int(symbols.max()) + 1
    s = np.concatenate([symbols.astype(np.int64), np.zeros(leading + 3, np.int64)])
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    keys = _packed([s[sample + j] for j in range(leading)], [bound] * leading)
    order = np.argsort(keys, kind="stable")
    names = np.empty(len(sample), np.int64)
    names[order] = np.concatenate([[1], 1 + np.cumsum(np.diff(keys[order]) != 0)])
    if names[order[-1]] < len(sample):
        order = suffix_array(names)
    rank = np.zeros(n + leading + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    ranks = len(sample) + 2
    zeros = np.arange(0, n, 3)
    zeros = zeros[np.argsort(_packed([s[zeros], rank[zeros + 1]], [bound, ranks]), kind="stable")]
    # merge: how many sampled suffixes of each residue come before each remaining one
    ones, twos = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    both = np.concatenate([zeros, ones])
    key = _packed([s[both], rank[both + 1]], [bound, ranks])
    before = np.searchsorted(key[len(zeros) :], key[: len(zeros)])
    both = np.concatenate([zeros, twos])
    key = _packed([s[both], s[both + 1], rank[both + 2]], [bound, bound, ranks])
    before = before + np.searchsorted(key[len(zeros) :], key[: len(zeros)])
    out = np.empty(n, np.int64)
    at = np.arange(len(zeros)) + before
    out[at] = zeros
    rest = np.ones(n, bool)
    rest[at] = False
    out[rest] = sampled
    return out


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one integer."""
    return np.ndarray((len(buf),), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,)).copy()


def repeated_by_suffixes(buf: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each start, whether its `length` bytes equal those of another start: neighbours in a suffix array are compared."""
    array = suffix_array(buf.astype(np.int64) + 1, 7)
    slot = np.full(len(buf), -1)
    slot[starts] = np.arange(len(starts))
    own = slot[array]
    own = own[own >= 0]
    left, right = starts[own[:-1]], starts[own[1:]]
    eights, alive = _eights(buf), np.arange(len(left))
    for j in [*range(0, length - 7, 8), length - 8]:
        alive = alive[eights[left[alive] + j] == eights[right[alive] + j]]
    out = np.zeros(len(starts), bool)
    out[own[alive]] = out[own[alive + 1]] = True
    return out


def repeated_by_hashes(buf: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """As repeated_by_suffixes, for buckets whose suffix array would not fit."""
    one, two = (h.spans(h.sums(buf), starts, starts + length) for h in (_STRINGS, _MORE))
    order = np.lexsort((two, one))
    same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    out = np.zeros(len(starts), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def runs(batches: Iterator[pa.RecordBatch], length: int, cores: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows of (_id, _hash, core, whole, more, first, last): runs of window starts, a hash of the core and two of the run's string.

    cores: rows of (core) only.
    """
    for batch in C.slices(batches, limit=SLICE):
        ids, text_hash = batch.column("_id").to_numpy(), batch.column("_hash").to_numpy()
        buf, off = C.buffer_of(batch.column("_text"))
        valid = np.zeros(len(buf) + 1, np.int64)
        full = np.flatnonzero(np.diff(off) >= length)
        if not len(full):
            continue
        np.add.at(valid, off[full], 1)
        np.add.at(valid, off[full + 1] - length + 1, -1)
        at = np.flatnonzero(np.cumsum(valid))
        eights = _eights(buf)
        grams = C.mix(eights[: len(buf) - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15) + eights[GRAM - 8 : len(buf) - 7])
        least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        have = 1
        while have < SPAN:
            step = min(have, SPAN - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        anchor = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = anchor[1:] != anchor[:-1]
        first = np.flatnonzero(new)
        last = at[np.append(first[1:], len(at)) - 1]
        anchor, first = anchor[first], at[first]
        sums = _STRINGS.sums(buf)
        core = _STRINGS.spans(sums, anchor, anchor + length - SPAN + 1)
        if cores:
            yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64))], ["core"])
            continue
        shape = C.mix(((anchor - first) * (length + SPAN) + last - first).astype(np.uint64))
        whole = C.mix(_STRINGS.spans(sums, first, last + length) ^ shape)
        more = C.mix(_MORE.spans(_MORE.sums(buf), first, last + length) ^ shape)
        doc = np.searchsorted(off, first, "right") - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (ids[doc], text_hash[doc], core.view(np.int64), whole.view(np.int64), more.view(np.int64), first - off[doc], last - off[doc])], ["_id", "_hash", "core", "whole", "more", "first", "last"]
        )


def _strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows of (core, _id, _hash, first, known, string) from texts with the runs wanted of them."""
    for batch in C.slices(batches):
        out = []
        for i, h, text, wanted in zip(*(batch.column(k).to_pylist() for k in ("_id", "_hash", "_text", "wanted")), strict=True):
            raw = text.encode()
            out += [(w["core"], i, h, w["first"], w["known"], raw[w["first"] : w["last"] + length]) for w in wanted]
        names, kinds = ("core", "_id", "_hash", "first", "known", "string"), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        for k in range(0, len(out), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 2000], strict=True), kinds, strict=True)], names)


def _repeats(table: pa.Table, length: int) -> pa.RecordBatch:
    """Rows of (_id, _hash, first, end) of bytes that go, from the strings of whole buckets."""
    buf, off = C.buffer_of(C.flat(table.column("string")))
    windows = np.diff(off) - length + 1
    string = np.repeat(np.arange(len(windows)), windows)
    within = np.arange(len(string)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = off[string] + within
    twice = (repeated_by_suffixes if len(buf) <= HOT_BYTES else repeated_by_hashes)(buf, starts, length)
    known = C.flat(table.column("known")).to_numpy(zero_copy_only=False)
    hit = np.flatnonzero(twice & ~known[string])
    ids, text_hash, first = (C.flat(table.column(k)).to_numpy() for k in ("_id", "_hash", "first"))
    new = np.ones(len(hit), bool)
    new[1:] = (string[hit[1:]] != string[hit[:-1]]) | (within[hit[1:]] != within[hit[:-1]] + 1)
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(hit)) - 1 if len(a) else a
    a, b = hit[a], hit[b]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[string[a]], text_hash[string[a]], first[string[a]] + within[a], first[string[b]] + within[b] + length)], ["_id", "_hash", "first", "end"])


def _sorted_buckets(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Batches of whole buckets, from strings sorted by core."""
    for table in C.whole_groups(batches, "core", 1_500):
        core, size = C.flat(table.column("core")).to_numpy(), np.diff(C.buffer_of(C.flat(table.column("string")))[1])
        ends = np.append(np.flatnonzero(np.diff(core)) + 1, len(core))
        at, total = 0, np.append(0, np.cumsum(size))
        while at < len(core):
            fits = ends[(ends > at) & (total[ends] - total[at] <= BATCH_BYTES)]
            to = int(fits[-1]) if len(fits) else int(ends[np.searchsorted(ends, at, "right")])
            yield _repeats(table.slice(at, to - at), length)
            at = to


def _source(docs: DataFrame) -> DataFrame:
    return C.texts(docs).withColumn("_hash", F.xxhash64("_text"))


def _window_hashes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows of (one, two, _id, _hash, first, known) for each window of strings."""
    for batch in C.slices(batches, "string", 256 << 10):
        buf, off = C.buffer_of(batch.column("string"))
        windows = np.diff(off) - length + 1
        string = np.repeat(np.arange(len(windows)), windows)
        within = np.arange(len(string)) - np.repeat(np.cumsum(windows) - windows, windows)
        starts = off[string] + within
        one, two = (h.spans(h.sums(buf), starts, starts + length).view(np.int64) for h in (_STRINGS, _MORE))
        ids, text_hash, first = (batch.column(k).to_numpy() for k in ("_id", "_hash", "first"))
        known = batch.column("known").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (one, two, ids[string], text_hash[string], first[string] + within, known[string])], ["one", "two", "_id", "_hash", "first", "known"])


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(_id, _hash, first, end): spans of bytes in strings of `length` that also start elsewhere. Spans may overlap."""
    if length < SPAN + GRAM:
        raise ValueError(f"length must be {SPAN + GRAM} or more")
    C.with_checkpoints(docs.sparkSession)
    n = C.shuffle_partitions(docs.sparkSession)
    source = _source(docs)
    # runs whose core occurs twice or more
    cores = source.mapInArrow(lambda it: runs(it, length, True), "core long").groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(C.anew("core").alias("key"))
    found = source.mapInArrow(lambda it: runs(it, length), "_id long, _hash long, core long, whole long, more long, first long, last long")
    shared = found.withColumn("key", C.anew("core")).join(cores, "key").checkpoint()
    # classes of equal runs: those of two or more repeat as a whole
    classes = shared.groupBy("core", "whole", "more").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_id", "_hash", "first", "last")).alias("one"))
    whole = shared.join(classes.filter("n > 1").select(C.anew("core").alias("key"), "whole", "more"), ["key", "whole", "more"]).select("_id", "_hash", "first", (F.col("last") + length).alias("end"))
    # one string of each class of the cores that have a single run, which only its windows can tell about
    opened = classes.groupBy("core").agg(F.count_if(F.col("n") == 1).alias("single"), F.count(F.lit(1)).alias("k")).filter("single > 0 and k > 1").select(C.anew("core").alias("key"), (F.col("k") > HOT_CLASSES).alias("hot"))
    sent = classes.withColumn("key", C.anew("core")).join(opened, "key").select("core", "one.*", (F.col("n") > 1).alias("known"), "hot").checkpoint()

    def strings(chosen: DataFrame) -> DataFrame:
        wanted = chosen.groupBy("_id", "_hash").agg(F.collect_list(F.struct("core", "first", "last", "known")).alias("wanted"))
        return source.join(wanted, ["_id", "_hash"]).mapInArrow(lambda it: _strings(it, length), "core long, _id long, _hash long, first long, known boolean, string binary")

    settled = strings(sent.filter("not hot")).repartition(n, "core").sortWithinPartitions("core").mapInArrow(lambda it: _sorted_buckets(it, length), "_id long, _hash long, first long, end long")
    out = whole.unionByName(settled)
    if not sent.filter("hot").isEmpty():
        hashed = strings(sent.filter("hot")).mapInArrow(lambda it: _window_hashes(it, length), "one long, two long, _id long, _hash long, first long, known boolean")
        twice = hashed.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(C.anew("one").alias("key"), "two")
        out = out.unionByName(hashed.filter("not known").withColumn("key", C.anew("one")).join(twice, ["key", "two"]).select("_id", "_hash", "first", (F.col("first") + length).alias("end")))
    return out


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.slices(batches):
        out = []
        for text, spans in zip(batch.column("_text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            raw, gone, n, at, kept = text.encode(), 0, 0, 0, []
            joined: list[list[int]] = []
            for a, b in sorted((x["first"], x["end"]) for x in spans or ()):
                if joined and a <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], b)
                else:
                    joined.append([a, b])
            for a, b in joined:
                kept.append(raw[at:a])
                at, gone, n = b, gone + b - a, n + 1
            kept.append(raw[at:])
            out.append((len(raw), gone, n, b"".join(kept)))
        columns = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([batch.column("_id"), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], ["_id", "n_bytes", "n_removed", "n_spans", "kept"])


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay)."""
    spans = repeated_spans(docs, length).groupBy("_id", "_hash").agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    joined = _source(docs).join(spans, ["_id", "_hash"], "left").select("_id", "_text", "spans")
    return joined.mapInArrow(_remove, "_id long, n_bytes long, n_removed long, n_spans long, kept binary").select(C.original_id(), "n_bytes", "n_removed", "n_spans", "kept")


def op2_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
