"""Line dedup by a segment-partition edit join (operator 1).

Lines are the \\n-separated parts of a text; lines of white space only are left alone. Of equal lines anywhere in the
table the first occurrence (least doc_id, then line number) stays. A line of `least` or more characters also goes, in all
its occurrences, if a line within `edits` edits (insertions, deletions, substitutions of code points) first occurs before
it. The rule looks at the input only, so it does not depend on the order of work.

Each line is an index entry by its `edits` + 1 segments, one of which a close line must hold unchanged. A line probes the
segments of lines of its own and lesser lengths at the few starts that the length difference allows (multi-match-aware
substrings). Entries and probes are 16-byte rows, streamed by segment; rows whose segment no other line shares drop out,
and only lines that are left are fetched and sent to their segments' groups, where an automaton of banded bit-parallel
edit distance, vectorised over pairs, verifies. A segment of over BLOCK lines is dealt out as pairs of blocks, so one
hot segment is no single task. A group emits a row for each line that goes, never its pairs, and a line that is known to
go is verified against no further line of its group.

Shuffled: about 24 bytes for each entry or probe (12 a line at two edits), occurrences (hashes, no text), the border lines,
and the texts once for each use, which Spark may share. A common line is aggregated before it is joined back.

Defined results: a null text has no lines and stays null; empty texts stay empty; lines are equal if 126 bits of their XXH3 are;
rows that repeat a document repeat its lines, and of rows of the same doc_id and text each keeps what the first does; a
null doc_id comes after all others; an empty table gives an empty result; other columns are kept by line_dedup.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

EDITS = 2
#: Shorter lines are compared for equality only.
LEAST = 30
#: Bytes of texts whose lines one pass works on.
SLICE = 512 << 10
#: Pairs that one pass of the automaton works on.
PAIRS = 200_000
#: Lines that a task remembers as sent, twice at most.
RECENT = 200_000
#: Rows of a segment that are verified in one group; larger segments become groups of two blocks each.
BLOCK = 4_096

_LINES = C.SpanHash(21)


class _Lines:
    """The lines of a slice of texts: code points, bounds, text, number, and 126 bits of hash in two columns."""

    def __init__(self, texts: list[str]):
        self.points = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
        breaks = np.flatnonzero(self.points == 10)
        self.starts, self.ends = np.append(0, breaks + 1), np.append(breaks, len(self.points))
        text_starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        first = np.searchsorted(self.starts, text_starts)
        self.text = np.searchsorted(text_starts, self.starts, "right") - 1
        self.number = np.arange(len(self.starts)) - first[self.text]
        blank = (self.points == 32) | ((self.points >= 9) & (self.points <= 13))
        full = np.append(0, np.cumsum(~blank))
        keep = full[self.ends] > full[self.starts]
        self.starts, self.ends, self.text, self.number = (x[keep] for x in (self.starts, self.ends, self.text, self.number))
        raw = memoryview(self.points).cast("B")
        both = b"".join([xxhash.xxh3_128_digest(raw[4 * a : 4 * b]) for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)])
        one, two = np.frombuffer(both, "<u8").reshape(-1, 2).T
        self.hash, self.more = (one >> np.uint64(2)).astype(np.int64), two.astype(np.uint64).view(np.int64)

    def sums(self) -> np.ndarray:
        return _LINES.sums_of(C.mix(self.points.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.slices(batches, limit=SLICE):
        x = _Lines(batch.column("_text").to_pylist())
        ids, text_hash = batch.column("_id").to_numpy(), batch.column("_hash").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (x.hash, x.more, ids[x.text], text_hash[x.text], x.number)], ["line", "more", "_id", "_hash", "number"])


def _segment(length: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i of lines of these lengths."""
    m = edits + 1
    base, longer = length // m, m - length % m
    return i * base + np.maximum(0, i - longer), base + (i >= longer)


def _segments(batches: Iterator[pa.RecordBatch], edits: int, least: int) -> Iterator[pa.RecordBatch]:
    """Rows of (segment, line): index entries have an odd line, probes an even one (twice the line's hash).

    A task sends a line once while it is among the lines of its last slices, however common it is.
    """
    sent, recent = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in C.slices(batches, limit=SLICE):
        x = _Lines(batch.column("_text").to_pylist())
        size = x.ends - x.starts
        one = np.unique(x.hash, return_index=True)[1]
        one = one[size[one] >= least]
        one = one[~(np.isin(x.hash[one], sent) | np.isin(x.hash[one], recent))]
        recent = np.concatenate([recent, x.hash[one]])
        if len(recent) > RECENT:
            sent, recent = recent, np.empty(0, np.int64)
        if not len(one):
            continue
        sums = x.sums()
        starts, size, line = x.starts[one], size[one], x.hash[one] << 1
        for less in range(edits + 1):
            length = size - less
            some = np.flatnonzero(length >= least)
            for i in range(edits + 1):
                at, n = _segment(length[some], i, edits)
                for shift in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1):
                    index = less == 0 and shift == 0
                    start = at + shift
                    ok = (start >= 0) & (start + n <= size[some])
                    where = some[ok]
                    begin = starts[where] + start[ok]
                    key = C.mix(_LINES.spans(sums, begin, begin + n[ok]) ^ C.mix((length[where] * 64 + i).astype(np.uint64)))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(line[where] | int(index))], ["segment", "line"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(segment, line, rank) of segments that an index entry and another row share, each row once, counted from 0.

    Rows are sorted by segment, index entries first, then by line; they stream through, so no segment is held.
    """
    segment_before = line_before = held = None
    count, indexed = 0, False
    for batch in batches:
        segment, line = (batch.column(k).to_numpy() for k in ("segment", "line"))
        if not len(line):
            continue
        again = np.append(segment_before is not None and segment[0] == segment_before and line[0] == line_before, (segment[1:] == segment[:-1]) & (line[1:] == line[:-1]))
        segment, line = segment[~again], line[~again]
        if not len(line):
            continue
        new = np.append(segment_before is None or segment[0] != segment_before, segment[1:] != segment[:-1])
        first = np.flatnonzero(new)
        group = np.cumsum(new)
        begun = np.append(-count, first)
        rank = np.arange(len(line)) - begun[group]
        own = np.append(indexed, line[first] & 1 == 1)[group]
        followed = np.append(~new[1:], False)
        some = np.flatnonzero(own & ((rank > 0) | followed))
        out = [(segment[some], line[some], rank[some])]
        if held is not None and not new[0]:
            out.insert(0, held)
        held = None
        last = len(line) - 1
        segment_before, line_before, count, indexed = segment[last], line[last], int(rank[last]) + 1, bool(own[last])
        if indexed and rank[last] == 0:
            held = (segment[last:], line[last:], rank[last:])
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["segment", "line", "rank"])


def _groups(met: DataFrame) -> DataFrame:
    """met with `groups`, an array of (cell, side): the groups of rows that a row is verified in.

    A segment of over BLOCK rows is cut into blocks, and each pair of blocks, the first of which has index entries, is a
    group of its own with two sides, so a hot segment is many groups and no pair of rows that may meet is left out.
    """
    rank_of_index = F.when(F.col("line").bitwiseAND(F.lit(1).cast("long")) == 1, F.col("rank"))
    tops = met.groupBy("segment").agg(F.max("rank").alias("top"), F.max(rank_of_index).alias("top_index")).filter(F.col("top") >= BLOCK)
    marked = met.withColumn("_key", C.anew("segment")).join(tops.select(C.anew("segment").alias("_key"), "top", "top_index"), "_key", "left").drop("_key")

    def block(x):
        return F.floor(x / F.lit(BLOCK)).cast("long")

    def cells(blocks, is_first: bool):
        own = block(F.col("rank"))
        return F.transform(blocks, lambda b: F.struct(F.xxhash64("segment", own if is_first else b, b if is_first else own).alias("cell"), F.when(b == own, 0).otherwise(0 if is_first else 1).alias("side")))

    own, none = block(F.col("rank")), F.array().cast("array<bigint>")
    as_index = F.when(F.col("line").bitwiseAND(F.lit(1).cast("long")) == 1, F.sequence(own, block(F.col("top")))).otherwise(none)
    as_other = F.sequence(F.lit(0).cast("long"), F.least(own, block(F.col("top_index"))))
    hot = F.array_distinct(F.concat(cells(as_index, True), cells(as_other, False)))
    one = F.array(F.struct(F.col("segment").alias("cell"), F.lit(0).alias("side")))
    return marked.select("segment", "line", F.when(F.col("top").isNull(), one).otherwise(hot).alias("groups"))


def within(points: np.ndarray, a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray, edits: int) -> np.ndarray:
    """For each pair of spans of code points, whether their edit distance is at most `edits`.

    state[k] has a bit for each diagonal of the band that is reached with at most k edits; one step reads a code point
    of b for all pairs at once.
    """
    out = np.zeros(len(a), bool)
    alive = np.flatnonzero(np.abs(a_size - b_size) <= edits)
    width = 2 * edits + 1
    full = np.uint32((1 << width) - 1)
    padded = np.concatenate([np.zeros(edits, np.uint32), points, np.zeros(2 * edits + 2, np.uint32)])
    state = [np.full(len(alive), sum(1 << (edits + d) for d in range(k + 1)), np.uint32) for k in range(edits + 1)]
    j = 0
    while len(alive):
        done = b_size[alive] == j
        if done.any():
            ended = alive[done]
            out[ended] = (state[edits][done] >> (a_size[ended] - b_size[ended] + edits).astype(np.uint32)) & np.uint32(1) == 1
        go = ~done & (state[edits] != 0)
        if not go.all():
            alive, state = alive[go], [s[go] for s in state]
            if not len(alive):
                break
        char = points[b[alive] + j]
        equal = np.zeros(len(alive), np.uint32)
        place = a[alive] + j
        for d in range(width):
            equal |= (padded[place + d] == char).astype(np.uint32) << np.uint32(d)
        new = [state[0] & equal]
        for k in range(1, edits + 1):
            new.append(((state[k] & equal) | state[k - 1] | (state[k - 1] >> np.uint32(1)) | (new[k - 1] << np.uint32(1))) & full)
        state = new
        j += 1
    return out


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (cell, side, line, more, first id, first number, string) from texts with the lines wanted of them."""
    names = ("cell", "side", "line", "more", "id", "number", "string")
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    for batch in C.slices(batches):
        out = []
        for i, text, wanted in zip(*(batch.column(k).to_pylist() for k in ("_id", "_text", "wanted")), strict=True):
            lines = text.split("\n")
            for w in wanted:
                out += [(g["cell"], g["side"], w["line"], w["more"], i, w["number"], lines[w["number"]]) for g in w["groups"]]
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _verify(batches: Iterator[pa.RecordBatch], edits: int) -> Iterator[pa.RecordBatch]:
    """Rows of (line, more): hashes of lines that a close line comes before, from rows sorted by cell."""
    for table in C.whole_groups(batches, "cell", 4_000):
        cell, side, line, more, ids, number = (C.flat(table.column(k)).to_numpy() for k in ("cell", "side", "line", "more", "id", "number"))
        strings = table.column("string").to_pylist()
        points = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
        size = np.array([len(s) for s in strings])
        start = np.cumsum(size) - size
        # rows of a cell in order of first occurrence: row r meets the earlier rows of its cell, nearest to the front first
        order = np.lexsort((number, ids, cell))
        cell, side, line, more, ids, number, size, start = (x[order] for x in (cell, side, line, more, ids, number, size, start))
        begin = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        each = np.diff(np.append(begin, len(cell)))
        base = np.repeat(begin, each)
        crossed = np.repeat(np.maximum.reduceat(side, begin) > 0, each)
        gone = np.zeros(len(cell), bool)
        later = np.arange(len(cell))
        step = 0
        while True:
            # as many steps at a time as fit in one pass
            later = later[~gone[later] & (base[later] + step < later)]
            if not len(later):
                break
            steps = np.arange(step, step + max(1, PAIRS // len(later)))
            late = np.repeat(later, len(steps))
            early = base[late] + np.tile(steps, len(later))
            ok = early < late
            late, early = late[ok], early[ok]
            ok = ((line[late] | line[early]) & 1 == 1) & ((line[late] >> 1 != line[early] >> 1) | (more[late] != more[early])) & (~crossed[late] | (side[late] != side[early]))
            late, early = late[ok], early[ok]
            gone[late[within(points, start[early], size[early], start[late], size[late], edits)]] = True
            step = int(steps[-1]) + 1
        if gone.any():
            pairs = np.unique(np.column_stack([line[gone] >> 1, more[gone]]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["line", "more"])


def _source(docs: DataFrame) -> DataFrame:
    """_id, _text and _hash of each row of docs, and its other columns as _0, _1 and so on, _null for a null text."""
    others = [F.col(c).alias(f"_{k}") for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    whole = [F.col("doc_id").alias("_key"), F.col("text").isNull().alias("_null")] if others else []
    return C.texts(docs, *others, *whole).withColumn("_hash", F.xxhash64("_text"))


def lines_to_remove(source: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """(_id, _hash, number, near): the occurrences of lines that go; near: for a close line, not an equal one."""
    if least < 2 * (edits + 1):
        raise ValueError("segments need two characters or more")
    spark = C.with_checkpoints(source.sparkSession)
    n = C.shuffle_partitions(spark)
    own = source.select("_id", "_text", "_hash")
    seen = own.mapInArrow(_occurrences, "line long, more long, _id long, _hash long, number long").checkpoint()
    firsts = seen.groupBy("line", "more").agg(F.min(F.struct("_id", "number", "_hash")).alias("first"), F.count(F.lit(1)).alias("n"))
    entries = own.mapInArrow(lambda it: _segments(it, edits, least), "segment long, line long")
    index_first = F.col("line").bitwiseAND(F.lit(1).cast("long")).desc()
    met = entries.repartition(n, "segment").sortWithinPartitions("segment", index_first, "line").mapInArrow(_met, "segment long, line long, rank long").checkpoint()
    placed = _groups(met).withColumn("own", F.shiftright("line", 1)).join(firsts.withColumnRenamed("line", "own"), "own")
    wanted = placed.groupBy("first._id", "first._hash").agg(F.collect_list(F.struct("groups", "line", "more", F.col("first.number").alias("number"))).alias("wanted"))
    # all of source's columns are read, so that this join and the one that removes lines share one exchange of the texts
    strings = source.join(wanted, ["_id", "_hash"]).mapInArrow(_fetch, "cell long, side int, line long, more long, id long, number long, string string")
    close = strings.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(lambda it: _verify(it, edits), "line long, more long").distinct().withColumn("near", F.lit(True))
    key = C.anew("line").alias("key")
    decided = firsts.join(close, ["line", "more"], "left").select(key, "more", "first", F.coalesce("near", F.lit(False)).alias("near"), "n").filter("near or n > 1").drop("n")
    judged = seen.select(key, "more", "_id", "_hash", "number").join(decided, ["key", "more"])
    is_first = (F.col("_id") == F.col("first._id")) & (F.col("number") == F.col("first.number")) & (F.col("_hash") == F.col("first._hash"))
    return judged.filter(F.col("near") | ~is_first).select("_id", "_hash", "number", "near")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.slices(batches):
        out = []
        for text, numbers in zip(batch.column("_text").to_pylist(), batch.column("numbers").to_pylist(), strict=True):
            if numbers:
                gone = set(numbers)
                text = "\n".join([x for k, x in enumerate(text.split("\n")) if k not in gone])
            out.append(text)
        kept = [k for k in batch.schema.names if k not in ("_text", "numbers")]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(out, pa.string())], [*kept, "_kept"])


def _deduped(docs: DataFrame, edits: int, least: int) -> DataFrame:
    """The columns of _source but _text and _hash, n_exact, n_near and _kept for each row of docs."""
    source = _source(docs)
    # a set, for rows that repeat a document repeat its lines
    marked = lines_to_remove(source, edits, least).groupBy("_id", "_hash").agg(F.collect_set(F.struct("number", "near")).alias("x"))
    n_near = F.size(F.filter("x", lambda x: x["near"]))
    gone = marked.select("_id", "_hash", F.col("x.number").alias("numbers"), (F.size("x") - n_near).alias("n_exact"), n_near.alias("n_near"))
    joined = source.join(gone, ["_id", "_hash"], "left").drop("_hash")
    schema = joined.drop("_text", "numbers").schema
    return joined.mapInArrow(_without, schema.add("_kept", "string"))


def line_dedup(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """docs with the lines that go taken out of text, and n_chars (if there) set to the new length."""
    narrow = set(docs.columns) == {"doc_id", "text"}
    done = _deduped(docs.select("*", F.lit(0).alias("_more")) if narrow else docs, edits, least)
    kept = F.when(~F.col("_null"), F.col("_kept"))

    def column(k: int, name: str):
        if name == "text":
            return kept.alias(name)
        if name == "doc_id":
            return F.col("_key").alias(name)
        if name == "n_chars":
            return F.when(F.col("_null"), F.col(f"_{k}")).otherwise(F.length("_kept").cast(docs.schema[name].dataType)).alias(name)
        return F.col(f"_{k}").alias(name)

    return done.select(*(column(k, c) for k, c in enumerate(docs.columns)))


def line_dedup_counts(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """One row for each row of docs: doc_id, n_exact and n_near (lines that went), kept (what stays of the text)."""
    done = _deduped(docs.select("doc_id", "text"), edits, least)
    return done.select(C.original_id(), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_exact", "n_near")), F.col("_kept").alias("kept"))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_exact", "n_near", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
