"""SimHash near-dedup (operator 5).

A text is lower-cased (A-Z), cut into words and into shingles of three words; bit b of its fingerprint is 1 if bit b is
set in over half of the shingles' XXH64. Fingerprints link at `radius` or fewer differing bits. They are split into
radius + 2 blocks: a close pair differs in at most `radius` blocks, so it shares two, and every pair of blocks is a table of
its own. Fingerprints that agree on a table's blocks meet in a sorted run of one partition, where the Hamming distance
is verified and a run emits one link for each fingerprint (to the least of its verified group), never all pairs. Links
become components by alternating star contractions over DataFrames.

Documents of one fingerprint are one node, so exact copies never meet. A run of n fingerprints costs n^2 / 2 comparisons
up to DENSE, and at a radius of 1 or 2 about radius^2 * 1,000 look-ups for each fingerprint beyond. Runs of over LARGE fingerprints, which are
counted first, are split by two blocks of their open bits in the same way, so a large family is no single task.

Defined results: a null or empty text has fingerprint zero, linked like any other; a text of under three words is one
shingle; a null doc_id belongs to the component of its fingerprint and comes last as its representative; rows that
repeat a doc_id each get their row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SHINGLE = 3
RADIUS = 2
SEED = 42
DENSE = 2_000
#: Pairs that a task holds before it joins their groups.
HELD = 1_000_000
#: Fingerprints of a run beyond which it is split further.
LARGE = 50_000


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    h, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.array([h(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist()))


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int, *more: str) -> Iterator[pa.RecordBatch]:
    for batch in C.slices(batches):
        out = np.array([fingerprint(x.as_py(), shingle) for x in batch.column("_text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("_id", *more)), pa.array(out)], ["_id", *more, "fp"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(_id, fp): the fingerprint as a signed long."""
    return C.texts(docs).mapInArrow(lambda it: _fingerprints(it, shingle), "_id long, fp long")


def _least_labels(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """The least index of each index's component."""
    labels = np.arange(n) if labels is None else labels
    while len(a):
        low = np.minimum(labels[a], labels[b])
        before = labels.copy()
        np.minimum.at(labels, labels[a], low)
        np.minimum.at(labels, labels[b], low)
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        while True:
            jumped = labels[labels]
            if np.array_equal(jumped, labels):
                break
            labels = jumped
        if np.array_equal(before, labels):
            break
    return labels


def _labels_of_runs(values: np.ndarray, run: np.ndarray, radius: int) -> np.ndarray:
    """The least index that each value is connected to by values of its run within `radius` bits; runs are contiguous."""
    n, labels = len(values), np.arange(len(values))
    found, held = [], 0
    step = 1
    alive = np.arange(n)
    while True:
        alive = alive[alive + step < n]
        alive = alive[run[alive] == run[alive + step]]
        if not len(alive):
            break
        hit = alive[np.bitwise_count(values[alive] ^ values[alive + step]) <= radius]
        if len(hit):
            found.append((hit, hit + step))
            held += len(hit)
        if held > HELD:
            labels = _least_labels(n, *(np.concatenate(x) for x in zip(*found, strict=True)), labels)
            found, held = [], 0
        step += 1
    if found:
        labels = _least_labels(n, *(np.concatenate(x) for x in zip(*found, strict=True)), labels)
    return labels


def _dense_labels(values: np.ndarray, radius: int) -> np.ndarray:
    """As _least_labels, for one large run of distinct ascending values: each looks up its neighbours' values."""
    bits = [np.uint64(1 << b) for b in range(64) if len(np.unique((values >> np.uint64(b)) & np.uint64(1))) > 1]
    labels = np.arange(len(values))
    while True:
        before = labels.copy()
        for size in range(1, radius + 1):
            for flips in combinations(bits, size):
                want = values ^ np.bitwise_or.reduce(np.array(flips, np.uint64))
                at = np.minimum(np.searchsorted(values, want), len(values) - 1)
                hit = np.flatnonzero(values[at] == want)
                if len(hit):
                    labels = _least_labels(len(values), hit, at[hit], labels)
        if np.array_equal(before, labels):
            return labels


def links_in_tables(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows of (a, b) from rows of (table, block, fp) sorted by all three: each fp's link to its group's least."""
    for table in C.whole_groups(batches, "block"):
        t, block, fp = (C.flat(table.column(k)).to_numpy() for k in ("t", "block", "fp"))
        values = fp.view(np.uint64)
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(t)))
        run = np.cumsum(new) - 1
        dense = DENSE if radius <= 2 else len(t)
        small = np.flatnonzero((size[run] > 1) & (size[run] <= dense))
        out = []
        if len(small):
            labels = _labels_of_runs(values[small], run[small], radius)
            moved = np.flatnonzero(labels != np.arange(len(small)))
            out.append((fp[small[moved]], fp[small[labels[moved]]]))
        for k in np.flatnonzero(size > dense):
            own = slice(first[k], first[k] + size[k])
            order = np.argsort(values[own])
            labels = _dense_labels(values[own][order], radius)
            moved = np.flatnonzero(labels != np.arange(size[k]))
            out.append((fp[own][order][moved], fp[own][order][labels[moved]]))
        if out:
            a, b = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def close_links(values: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): enough links between distinct values of column fp to join all that are connected at this radius."""
    C.with_checkpoints(values.sparkSession)
    n = C.shuffle_partitions(values.sparkSession)
    blocks = radius + 2
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum(1 << b for b in range(cuts[k], cuts[k + 1])) for k in range(blocks)]
    keep = [masks[i] | masks[j] for i, j in combinations(range(blocks), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in keep]
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("block")) for t, m in enumerate(signed)))
    rows = values.select("fp", F.explode(tables).alias("x")).select("x.t", "x.block", "fp")
    # runs of over LARGE fingerprints are split by the same rule over the bits that the run leaves open
    large = rows.groupBy("t", "block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LARGE).select("t", C.anew("block").alias("_key")).checkpoint()
    if not large.isEmpty():
        keyed = rows.withColumn("_key", C.anew("block"))
        hot = keyed.join(large, ["t", "_key"], "left_semi")
        finer = F.when(F.lit(False), F.array().cast("array<struct<t:int,block:bigint>>"))
        for t, m in enumerate(keep):
            finer = finer.when(F.col("t") == t, _finer(t, len(keep), m, radius))
        split = hot.select("t", "block", "fp", F.explode(finer).alias("x")).select("x.t", "x.block", "fp")
        rows = keyed.join(large, ["t", "_key"], "left_anti").select("t", "block", "fp").unionByName(split)
    dealt = rows.repartition(n, "t", "block").sortWithinPartitions("block", "t", "fp")
    return dealt.mapInArrow(lambda it: links_in_tables(it, radius), "a long, b long").filter("a <> b").distinct()


def _finer(t: int, tables: int, fixed: int, radius: int):
    """Sub-tables of table t: its bits and two of radius + 2 blocks of the others; at radius 2, a fourth of the 64 bits
    stay open, so that no run holds over 65,536 different fingerprints."""
    rest = [b for b in range(64) if not fixed >> b & 1]
    blocks = radius + 2
    cuts = [len(rest) * k // blocks for k in range(blocks + 1)]
    masks = [fixed | sum(1 << rest[b] for k in pair for b in range(cuts[k], cuts[k + 1])) for pair in combinations(range(blocks), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*(F.struct(F.lit(tables + t * len(masks) + k).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("block")) for k, m in enumerate(signed)))


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of each linked node's component, by alternating large and small stars.

    Each star is a grouped minimum joined back, so a node of very many links is aggregated before it is shuffled and its
    rows may be split. Lineage is cut in the shared checkpoint folder after each round.
    """
    spark = C.with_checkpoints(links.sparkSession)

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("m"))
        if large:
            both = both.union(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
        moved = both.join(least, "n")
        if large:
            out = moved.filter("m > n").select(F.col("m").alias("u"), F.col("low").alias("v"))
        else:
            out = moved.select(F.col("m").alias("u"), F.col("low").alias("v")).union(least.select(F.col("n").alias("u"), F.col("low").alias("v")))
        return out.filter("u <> v").distinct()

    def state(edges: DataFrame):
        return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    seen = None
    while True:
        edges = star(star(edges, True), False).checkpoint()
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _rooted(prints: DataFrame, least, radius: int) -> DataFrame:
    """fp, least and root (the least fp reachable) of each distinct fp of prints; least is an aggregate of that name."""
    distinct = prints.groupBy("fp").agg(least)
    roots = components(close_links(distinct.select("fp"), radius))
    return distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row for each row of docs: _id, fp, component_id (the least _id reachable, itself included)."""
    C.with_checkpoints(docs.sparkSession)
    prints = fingerprints(docs, shingle).checkpoint()
    rooted = _rooted(prints, F.min("_id").alias("least"), radius)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("_id", "fp", "component_id")


def simhash_dedup(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, all columns, that stay: of each component the row of the least doc_id.

    Of rows that repeat that doc_id, or have none, the one of the least text hash stays (equal texts: any of the equal
    rows). Texts of one doc_id, or of none, that lie in different components are told apart.
    """
    C.with_checkpoints(docs.sparkSession)
    hashed = C.texts(docs).withColumn("_hash", F.xxhash64("_text"))
    prints = hashed.mapInArrow(lambda it: _fingerprints(it, shingle, "_hash"), "_id long, _hash long, fp long").checkpoint()
    rooted = _rooted(prints, F.min(F.struct("_id", "_hash")).alias("least"), radius)
    stay = rooted.groupBy("root").agg(F.min("least").alias("least")).select("least.*")
    return C.packed_texts(docs).join(stay, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"]).select("_row.*")


def op5_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return out.select(C.original_id(), hexed, F.when(F.col("component_id") != C.NO_ID, F.col("component_id")).alias("component_id"))
