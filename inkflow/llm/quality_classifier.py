"""A quality classifier: histogram gradient-boosted trees over document statistics (operator 6).

Statistics of every whole text are computed by numpy over byte buffers where the texts are read, and written once to
the shared checkpoint folder (26 floats a document). Trees are fitted on at most `most` labelled rows outside the held-out fold, chosen by a
hash of doc_id; MOST_ROWS is the bound of the sample that may be collected. Fitted trees are flattened into arrays of
features, thresholds, children and leaf values, so scoring is a loop over trees and levels with numpy indexing.

Defined results: a null text is scored as empty; every row gets a score, also rows that repeat a doc_id; labels of null
doc_id or null quality are ignored, a doc_id with several labels takes the greatest; without labels, or with labels of
one class, scores are the smoothed share of label 1; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Labelled rows that are collected for fitting, at most.
MOST_ROWS = 20_000
THRESHOLD = 0.3
FOLDS = 5

STATISTICS = (
    "bytes", "words", "lines", "word_length", "word_length_sd", "longest_word", "distinct_words", "repeated_trigrams", "commonest_word", "short_words", "long_words",
    "letters", "upper", "digits", "symbols", "pipes", "sentence_marks", "commas", "other_marks", "non_ascii", "white_space", "line_length", "repeated_lines", "short_lines", "capital_words", "non_letter_words",
)

_HASH = C.SpanHash(7)


def _class(*chars: str | range) -> np.ndarray:
    out = np.zeros(256, bool)
    for c in chars:
        out[[ord(x) for x in c] if isinstance(c, str) else c] = True
    return out


_UPPER, _LOWER, _DIGIT = _class(range(65, 91)), _class(range(97, 123)), _class(range(48, 58))
_HIGH = _class(range(128, 256))
_CLASSES = {
    "letters": _UPPER | _LOWER | _HIGH, "upper": _UPPER, "digits": _DIGIT, "symbols": _class("#*$%&<>@^~_=+\\"), "pipes": _class("|"), "sentence_marks": _class(".!?"),
    "commas": _class(",;:"), "other_marks": _class("()[]{}\"'/-`"), "non_ascii": _HIGH, "white_space": C._SPACE,
}


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text."""
    buf, off = C.buffer_of(texts)
    m = len(off) - 1
    size = np.diff(off)
    starts, ends, doc = C.word_spans(buf, off)
    words = np.bincount(doc, minlength=m)
    some = np.maximum(words, 1)
    long = ends - starts

    def per(values, by=doc):
        return np.bincount(by, values, minlength=m)

    def extra(hashes, by, total):
        """Share of places whose hash is not the first of its text."""
        order = np.lexsort((hashes, by))
        h, d = hashes[order], by[order]
        same = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
        return np.bincount(d[1:][same], minlength=m) / np.maximum(total, 1), h, d

    out = {"bytes": np.log1p(size), "words": np.log1p(words)}
    mean = per(long) / some
    out |= {"word_length": mean, "word_length_sd": np.sqrt(np.maximum(per(long * long) / some - mean**2, 0)), "short_words": per(long <= 2) / some, "long_words": per(long >= 14) / some}
    longest = np.zeros(m, np.int64)
    np.maximum.at(longest, doc, long)
    out["longest_word"] = np.log1p(longest)
    sums = _HASH.sums(buf)
    word = C.word_hashes(buf, starts, ends)[0]
    share, h, d = extra(word, doc, words)
    out["distinct_words"] = 1 - share
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    most = np.zeros(m, np.int64)
    np.maximum.at(most, d[first], np.diff(np.append(first, len(h))))
    out["commonest_word"] = most / some
    grams = C.ngram_hash(word, 3, 0x9E3779B97F4A7C15)
    whole = np.flatnonzero(doc[: len(grams)] == doc[2:]) if len(doc) > 2 else np.empty(0, np.int64)
    out["repeated_trigrams"] = extra(grams[whole], doc[whole], np.bincount(doc[whole], minlength=m))[0]
    for name, members in _CLASSES.items():
        count = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(members[buf], out=count[1:])
        out[name] = (count[off[1:]] - count[off[:-1]]) / np.maximum(size, 1)
    out["capital_words"] = per(_UPPER[buf[starts]]) / some
    out["non_letter_words"] = per(~_CLASSES["letters"][buf[starts]]) / some
    breaks = np.flatnonzero(buf == 10)
    line_starts = np.sort(np.concatenate([off[:-1][size > 0], breaks + 1]))
    line_doc = np.searchsorted(off, line_starts, "right") - 1
    inside = np.concatenate([off[:-1][size > 0], breaks + 1])
    owner = np.concatenate([np.flatnonzero(size > 0), np.searchsorted(off, breaks, "right") - 1])
    order = np.lexsort((owner, inside))
    line_starts, line_doc = inside[order], owner[order]
    next_break = np.append(breaks, len(buf))[np.searchsorted(breaks, line_starts)]
    line_ends = np.maximum(np.minimum(next_break, off[line_doc + 1]), line_starts)
    full = line_ends > line_starts
    line_starts, line_ends, line_doc = line_starts[full], line_ends[full], line_doc[full]
    lines = np.bincount(line_doc, minlength=m)
    out["lines"] = np.log1p(lines)
    out["line_length"] = np.log1p(per(line_ends - line_starts, line_doc) / np.maximum(lines, 1))
    out["repeated_lines"] = extra(_HASH.spans(sums, line_starts, line_ends), line_doc, lines)[0]
    out["short_lines"] = per(line_ends - line_starts < 30, line_doc) / np.maximum(lines, 1)
    return np.column_stack([out[k] for k in STATISTICS]).astype(np.float32)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.slices(batches):
        x = statistics(batch.column("_text"))
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))], ["_id", "x"])


@dataclass(frozen=True)
class Forest:
    """Trees as arrays; node k of tree t splits feature[t, k] at threshold[t, k] into nodes 2k + 1 and 2k + 2."""

    base: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 150, depth: int = 4, rate: float = 0.1, bins: int = 64, ridge: float = 1.0, least: float = 5.0) -> Forest:
    """Newton boosting of the logistic loss; each level's splits come from histograms of binned statistics."""
    n = len(y)
    base = float(np.log((y.sum() + 1) / (n - y.sum() + 1))) if n else 0.0
    inner, leaves = 2**depth - 1, 2**depth
    empty = Forest(base, depth, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, leaves)))
    if n < 2 or y.min() == y.max():
        return empty
    edges = [np.unique(np.quantile(c, np.arange(1, bins) / bins).astype(np.float32)) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    k = x.shape[1]
    flat = binned + np.arange(k) * bins
    margin = np.full(n, base)
    features, thresholds, leaf_values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        for level in range(depth):
            nodes, first = 2**level, 2**level - 1
            slot = ((at - first)[:, None] * (k * bins) + flat).ravel()
            gs = np.bincount(slot, np.repeat(g, k), nodes * k * bins).reshape(nodes, k, bins).cumsum(axis=2)
            hs = np.bincount(slot, np.repeat(h, k), nodes * k * bins).reshape(nodes, k, bins).cumsum(axis=2)
            gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain[(hs < least) | (ht - hs < least)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for j in range(nodes):
                f, b = divmod(int(best[j]), bins)
                if gain[j, f, b] > 1e-6 and b < len(edges[f]):
                    feature[first + j], threshold[first + j] = f, edges[f][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        own = at - inner
        leaf = rate * np.bincount(own, g, leaves) / (np.bincount(own, h, leaves) + ridge)
        margin += leaf[own]
        features.append(feature)
        thresholds.append(threshold)
        leaf_values.append(leaf)
    return Forest(base, depth, np.array(features), np.array(thresholds), np.array(leaf_values))


def fold_of(key: str = "doc_id"):
    """The fold of a row: crc32 of the id as text; 0 is held out."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS


def _scores(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array(batch.column("x").flatten().to_numpy(zero_copy_only=False), np.float32).reshape(batch.num_rows, len(STATISTICS))
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(forest.score(x))], ["_id", "score"])


def document_statistics(docs: DataFrame) -> DataFrame:
    """(_id, x): the statistics of every row's text."""
    return C.texts(docs).mapInArrow(_statistics, "_id long, x array<float>")


def train(stats: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Forest:
    """Trees from at most `most` labelled rows of folds other than 0."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = stats.join(known.filter(fold_of() != 0).select(F.col("doc_id").cast("long").alias("_id"), "quality"), "_id")
    sample = rows.orderBy(F.xxhash64("_id", F.lit("fit")), "_id").limit(most).select("x", "quality").toArrow()
    x = sample.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)) if sample.num_rows else np.empty((0, len(STATISTICS)), np.float32)
    return fit(np.asarray(x, np.float32), (sample.column("quality").to_numpy() > 0).astype(float))


def classify_quality(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted."""
    C.with_checkpoints(docs.sparkSession)
    stats = document_statistics(docs).checkpoint()
    forest = train(stats, labels, most)
    scored = stats.mapInArrow(lambda it: _scores(it, forest), "_id long, score double").withColumn("doc_id", C.original_id())
    return scored.select("doc_id", F.coalesce(fold_of() == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
