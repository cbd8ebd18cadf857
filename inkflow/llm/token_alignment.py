"""Cross-tokenizer alignment (operator 11).

Two vocabularies encode the same bytes, and byte offsets where tokens of both end cut them into groups. A text is cut into
segments before each run of white space that begins with a space: there no token of either vocabulary can lie across, which
`Pair` verifies on the vocabularies themselves (no token holds a space after anything but white space) and on every
segment that is aligned (a token that crossed would end elsewhere, and raises). So a segment's tokens are the same
wherever it stands, and distinct segments are tokenised and aligned once:

1. `_cut`, a pass over the texts: the documents of a slice become sequences of numbers of the slice's distinct segments;
2. `_align`: these are dealt out and sorted by segment, equal ones meet, and many segments are tokenised by one call; their
   alignments go back to the slices they came from, packed;
3. an id pair's count is summed from segments and how often they occur, by partial sums a task;
4. `_compose`: a slice's documents are put together from the alignments of its segments, and its links are scored. Counts of
   pairs are broadcast while there are at most PAIRS of them, which is counted first; beyond, they are joined to the pairs of
   each slice.

Texts cross the network only as numbers of segments. What a task holds is bounded by a slice, or one document, and its
distinct segments; a common segment has one row for each slice. The first two steps are written to the shared folder.

Defined results: a null or empty text has no tokens, nor has one that the second vocabulary changes (U+2581, which stands
for the space): zeros and an empty string. Strings of special tokens are plain text. Very long texts are a slice of their
own; rows that repeat a doc_id, or have none, each get their row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from . import common as C
from .warc import shared_folder

#: Bytes of text whose segments are numbered together.
SLICE = 16 << 20
#: Pairs of ids whose counts are broadcast at most (24 bytes each).
PAIRS = 1_000_000

#: What the second vocabulary writes for a space.
MARK = "▁"
_CUT = re.compile(r"(?<=\S) ")
_RUN = re.compile(r"\s ")


def packed(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers under 2^35 at seven bits a byte, the last byte of each under 128; and where each ends."""
    numbers = numbers.astype(np.uint64)
    size = 1 + sum((numbers >= np.uint64(1 << k)).astype(np.int64) for k in (7, 14, 21, 28))
    at = np.arange(5)
    spread = ((numbers[:, None] >> (7 * at).astype(np.uint64)) & np.uint64(127)).astype(np.uint8) | ((at < size[:, None] - 1) * 128).astype(np.uint8)
    return spread[at < size[:, None]], np.cumsum(size)


def unpacked(data: bytes | np.ndarray) -> np.ndarray:
    data = np.frombuffer(data, np.uint8)
    if not len(data):
        return np.empty(0, np.int64)
    ends = np.flatnonzero(data < 128) + 1
    starts = np.append(0, ends[:-1])
    place = np.arange(len(data)) - np.repeat(starts, ends - starts)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts)


def _pack(numbers: np.ndarray) -> bytes:
    return packed(numbers)[0].tobytes()


def _spans(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each of the consecutive runs of values."""
    total, ends = np.append(0, np.cumsum(values, dtype=np.int64)), np.cumsum(sizes, dtype=np.int64)
    return total[ends] - total[ends - sizes]


class Pair:
    """A byte-level vocabulary of the tokenizers library and one of sentencepiece, and what each id stands for."""

    def __init__(self, first: str, second: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        with open(first, encoding="utf-8") as f:
            spec = json.load(f)
        with open(second, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        split, normal = spec["pre_tokenizer"], model.normalizer_spec
        if spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError(f"{first} changes texts, or splits them in an unknown way")
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.add_dummy_prefix or not model.trainer_spec.byte_fallback:
            raise ValueError(f"{second} changes texts")
        byte = {c: b for b, c in enumerate(bpe._byte_symbols())}
        own = {i: bytes(byte[c] for c in token) for token, i in spec["model"]["vocab"].items()}
        pieces = [bytes([int(p.piece[3:5], 16)]) if p.type == p.BYTE else p.piece.replace(MARK, " ").encode() for p in model.pieces]
        for token in [*own.values(), *pieces]:
            if _CUT.search(token.decode(errors="replace")):
                raise ValueError(f"a token lies across the beginning of white space: {token!r}")
        self.tokens = [own.get(i, b"") for i in range(max(own, default=-1) + 1)], pieces
        self.buffers = [np.frombuffer(b"".join(x), np.uint8) for x in self.tokens]
        self.ends = [np.append(0, np.cumsum([len(t) for t in x])).astype(np.int64) for x in self.tokens]
        # each id's decimal digits, and a byte for what follows it
        digits = [f"{i} ".encode() for i in range(max(map(len, self.tokens)))]
        self.digits, self.digit_ends = np.frombuffer(b"".join(digits), np.uint8), np.append(0, np.cumsum([len(x) for x in digits])).astype(np.int64)

    def _encoded(self, text: str, raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and where their bytes end in a text that begins with a space, for both vocabularies."""
        # the library adds a space, but not to an empty text
        second = self.b.encode(text[1:]) if len(text) > 1 else [self.b.piece_to_id(MARK)]
        for side, ids in enumerate((self.a.encode(text, add_special_tokens=False).ids, second)):
            ids = np.array(ids, np.int64)
            found, off = C.gather(self.buffers[side], self.ends[side][ids], self.ends[side][ids + 1])
            if found.tobytes() != raw:
                raise ValueError("a vocabulary changes the text of a segment")
            yield ids, off[1:]

    def align(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, how many of them each segment has): 4 id + 2 if a group ends + 1 for the second vocabulary's, the first
        vocabulary's of each group before the second's.

        Segments are encoded one after another in one text, but for those that end in white space, after which no
        segment can follow."""
        alone = [k for k, s in enumerate(segments) if s[-1].isspace()]
        joined = [k for k, s in enumerate(segments) if not s[-1].isspace()]
        order, tokens, sizes = [], [], []
        for own in ([joined] if joined else []) + [[k] for k in alone]:
            part = [segments[k].encode() for k in own]
            raw = b"".join(part)
            (ids_a, ends_a), (ids_b, ends_b) = self._encoded(raw.decode(), raw)
            stops, ends = np.intersect1d(ends_a, ends_b, assume_unique=True), np.cumsum([len(x) for x in part])
            if not np.isin(ends, stops, assume_unique=True).all():
                raise ValueError("a token lies across two segments")
            group = np.append(np.searchsorted(stops, ends_a), np.searchsorted(stops, ends_b))
            second = np.append(np.zeros(len(ids_a), np.int64), np.ones(len(ids_b), np.int64))
            last = np.append(np.zeros(len(ids_a), bool), np.isin(ends_b, stops, assume_unique=True))
            by = np.argsort(2 * group + second, kind="stable")
            tokens.append((4 * np.append(ids_a, ids_b) + 2 * last + second)[by])
            sizes.append(np.bincount(np.searchsorted(ends, stops)[group], minlength=len(own)))
            order += own
        flat, sizes, order = np.concatenate(tokens), np.concatenate(sizes), np.array(order)
        if alone:
            ends, back = np.cumsum(sizes), np.argsort(order)
            flat, _ = C.gather(flat, (ends - sizes)[back], ends[back])
            sizes = sizes[back]
        return flat, sizes

    def text(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What stands for each token, a1,a2|b1; and so on, one after another, and the offsets."""
        ids, second, last = tokens >> 2, tokens & 1, tokens & 2
        out, off = C.gather(self.digits, self.digit_ends[ids], self.digit_ends[ids + 1])
        after = np.where(second == 0, np.where(np.append(second[1:], 1) == 1, ord("|"), ord(",")), np.where(last > 0, ord(";"), ord(",")))
        out[off[1:] - 1] = after
        return out, off

    @staticmethod
    def links(tokens: np.ndarray) -> np.ndarray:
        """The id pair of each group in order: its two last tokens."""
        ends = np.flatnonzero(tokens & 2)
        first = np.flatnonzero((tokens[:-1] & 1 == 0) & (tokens[1:] & 1 == 1))
        return (tokens[first] >> 2 << 32) | (tokens[ends] >> 2)


@lru_cache(2)
def load(first: str, second: str) -> Pair:
    return Pair(first, second)


def segments_of(text: str) -> list[str]:
    """The segments of a space and the text, each without the space it begins with."""
    return _CUT.split(text) if text[0] == " " or _RUN.search(text) else text.split(" ")


_PIECES = "slice long, _id long, codes binary, segment string, local long, n long"
_ALIGNED = "slice long, locals binary, counts binary, sizes binary, tokens binary"


def _cut(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Documents as numbers of their slice's segments, and the segments."""
    here, schema = TaskContext.get().partitionId(), pa.schema([("slice", pa.int64()), ("_id", pa.int64()), ("codes", pa.binary()), ("segment", pa.string()), ("local", pa.int64()), ("n", pa.int64())])
    at = 0
    numbers: dict[str, int] = defaultdict(count().__next__)
    ids: list[int] = []
    codes: list[np.ndarray | None] = []
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal at, numbers, ids, codes, held
        flat = np.concatenate([np.empty(0, np.int64), *(c for c in codes if c is not None)])
        data, ends = packed(flat)
        places = np.append(0, ends)[np.cumsum([0] + [0 if c is None else len(c) for c in codes])].tolist()
        name, m, n = (here << 32) | at, len(ids), len(numbers)
        raw = [None if c is None else data[a:b].tobytes() for c, a, b in zip(codes, places[:-1], places[1:], strict=True)]
        docs = [pa.array([name] * m, pa.int64()), pa.array(ids, pa.int64()), pa.array(raw, pa.binary()), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())]
        yield pa.RecordBatch.from_arrays(docs, schema=schema)
        segments = [pa.array([name] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array([" " + x for x in numbers], pa.string()), pa.array(np.arange(n)), pa.array(np.bincount(flat, minlength=n))]
        yield pa.RecordBatch.from_arrays(segments, schema=schema)
        at, numbers, ids, codes, held = at + 1, defaultdict(count().__next__), [], [], 0

    for batch in batches:
        for own, text in zip(batch.column("_id").to_pylist(), batch.column("_text"), strict=True):
            text = text.as_py()
            if held and held + len(text) > limit:
                yield from flush()
            ids.append(own)
            codes.append(np.array(list(map(numbers.__getitem__, segments_of(text))), np.int64) if text and MARK not in text else None)
            held += len(text)
    if ids:
        yield from flush()


def _align(batches: Iterator[pa.RecordBatch], first: str, second: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by segment (segment, slice, local, n) to one row for each slice with the alignments of its segments."""
    pair = load(first, second)
    for batch in batches:
        if not batch.num_rows:
            continue
        named = batch.column("segment").dictionary_encode()
        tokens, sizes = pair.align(named.dictionary.to_pylist())
        which, slices, local, n = (np.asarray(x) for x in (named.indices, batch.column("slice"), batch.column("local"), batch.column("n")))
        order = np.lexsort((local, slices))
        which, slices, local, n = which[order], slices[order], local[order], n[order]
        ends = np.cumsum(sizes)
        flat, off = C.gather(tokens, (ends - sizes)[which], ends[which])
        data, data_ends = packed(flat)
        at = np.append(0, data_ends)[off]
        cuts = np.append(np.flatnonzero(np.append(True, slices[1:] != slices[:-1])), len(slices)).tolist()
        rows = [(slices[a], _pack(np.diff(local[a:b], prepend=0)), _pack(n[a:b]), _pack(sizes[which[a:b]]), data[at[a] : at[b]].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        kinds = (pa.int64(), *[pa.binary()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["slice", "locals", "counts", "sizes", "tokens"])


def _summed(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(pairs, return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, inverse, n)
    return keys, total


def _pairs(batches: Iterator[pa.RecordBatch], most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """pair and n: how many links hold it, summed over as much of a task as holds `most` pairs."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        keys, total = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held[:] = [(keys, total)]
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total)], ["pair", "n"])

    for batch in batches:
        for n, sizes, tokens in zip(*(batch.column(k).to_pylist() for k in ("counts", "sizes", "tokens")), strict=True):
            n, sizes, tokens = map(unpacked, (n, sizes, tokens))
            held.append((Pair.links(tokens), np.repeat(n, _spans((tokens & 2) >> 1, sizes))))
        if sum(len(k) for k, _ in held) > most:
            out = flush()
            if out.num_rows > most // 2:
                yield out
                held.clear()
    if held:
        yield flush()


def _slice_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """slice and pair, each once for a row of alignments."""
    for batch in batches:
        for name, tokens in zip(batch.column("slice").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
            pairs = np.unique(Pair.links(unpacked(tokens)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), name)), pa.array(pairs)], ["slice", "pair"])


def _compose(table: pa.Table, pair: Pair, shared, digests: bool) -> pa.Table:
    """The documents of a slice from its rows: documents, alignments and, if counts are not shared, scores of pairs."""

    def column(rows: pa.Table, name: str) -> list:
        return rows.column(name).to_pylist()

    docs, aligned = table.filter(pc.is_valid(table["_id"])), table.filter(pc.is_valid(table["tokens"]))
    local = np.concatenate([np.empty(0, np.int64), *(np.cumsum(unpacked(x)) for x in column(aligned, "locals"))])
    sizes, tokens = (np.concatenate([np.empty(0, np.int64), *map(unpacked, column(aligned, k))]) for k in ("sizes", "tokens"))
    order, ends = np.argsort(local), np.cumsum(sizes)
    tokens, _ = C.gather(tokens, (ends - sizes)[order], ends[order])
    sizes = sizes[order]
    if shared is None:
        scores = table.filter(pc.is_valid(table["pair"])).sort_by("pair")
        keys, counts, best = (np.asarray(scores[k].combine_chunks()) for k in ("pair", "n", "best"))
    else:
        keys, counts, best = shared
    written, off = pair.text(tokens) if len(tokens) else (np.empty(0, np.uint8), np.zeros(1, np.int64))
    data, at = written.tobytes(), off[np.append(0, np.cumsum(sizes))].tolist()
    strings = [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    groups = _spans((tokens & 2) >> 1, sizes)
    place = np.searchsorted(keys, Pair.links(tokens))
    measures = [_spans(1 - (tokens & 1), sizes), _spans(tokens & 1, sizes), groups, _spans(best[place].astype(np.int64), groups), _spans(counts[place], groups)]
    codes = [x or b"" for x in column(docs, "codes")]
    flat = unpacked(b"".join(codes))
    lengths = np.array([int((np.frombuffer(x, np.uint8) < 128).sum()) for x in codes], np.int64)
    sums = [_spans(m[flat], lengths) for m in measures]
    out, start = [], 0
    for m in lengths.tolist():
        whole = b"".join([strings[c] for c in flat[start : start + m].tolist()])[:-1]
        out.append((hashlib.sha256(whole).hexdigest() if m else "") if digests else whole.decode())
        start += m
    n_a, n_b, n_groups, n_best, count_sum = map(pa.array, sums)
    return pa.table([docs["_id"], n_a, n_b, n_groups, n_groups, n_best, count_sum, pa.array(out, pa.string())], ["_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])


def vocabularies() -> tuple[str, str]:
    return bpe.vocabulary("byte_bpe_50k.json"), bpe.vocabulary("piece_bpe_32k.model")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair (id of the first vocabulary times 2^32 plus that of the second), n, and whether no pair of the second's id has more."""
    counts = aligned.mapInArrow(_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).withColumn("_b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    # one row for each id of the second vocabulary at most
    top = counts.groupBy("_b").agg(F.max("n").alias("_top"))
    return counts.join(F.broadcast(top), "_b").select("pair", "n", (F.col("n") == F.col("_top")).alias("best"))


def align(docs: DataFrame, first: str, second: str, digests: bool = False, pairs: int = PAIRS, limit: int = SLICE) -> DataFrame:
    """One row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, and groups, or its SHA-256."""
    spark = C.with_checkpoints(docs.sparkSession)
    folder = shared_folder(spark, "alignment")
    C.texts(docs).mapInArrow(lambda it: _cut(it, limit), _PIECES).write.option("compression", "zstd").parquet(f"{folder}/cut")
    cut = spark.read.parquet(f"{folder}/cut")
    segments = cut.filter("segment is not null").select("segment", "slice", "local", "n")
    dealt = segments.repartition(C.shuffle_partitions(spark), "segment").sortWithinPartitions("segment")
    dealt.mapInArrow(lambda it: _align(it, first, second), _ALIGNED).write.option("compression", "zstd").parquet(f"{folder}/aligned")
    aligned = spark.read.parquet(f"{folder}/aligned")
    counts = pair_counts(aligned).checkpoint()
    rows = cut.filter("segment is null").select("slice", "_id", "codes").unionByName(aligned.select("slice", "locals", "sizes", "tokens"), allowMissingColumns=True)
    shared = None
    if counts.count() <= pairs:
        known = counts.sort("pair").toArrow()
        shared = spark.sparkContext.broadcast(tuple(np.asarray(known[k].combine_chunks()) for k in ("pair", "n", "best")))
        rows = rows.select("*", F.lit(None).cast("long").alias("pair"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("boolean").alias("best"))
    else:
        own = aligned.mapInArrow(_slice_pairs, "slice long, pair long").distinct()
        rows = rows.unionByName(own.withColumn("_key", C.anew("pair")).join(counts.withColumn("_key", C.anew("pair")).drop("pair"), "_key").drop("_key"), allowMissingColumns=True)

    def compose(table: pa.Table) -> pa.Table:
        return _compose(table, load(first, second), None if shared is None else shared.value, digests)

    name = "groups_sha256" if digests else "groups"
    out = rows.groupBy("slice").applyInArrow(compose, "_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
    return out.select(C.original_id(), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias(name))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), *vocabularies(), digests=True)
