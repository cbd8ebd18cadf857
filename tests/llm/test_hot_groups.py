"""Strings that polynomials modulo a power of two confuse, and groups that are split: results equal brute force."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from fixtures import corpus, frame, tuples
from pyspark.sql import functions as F

import brute
from inkflow.llm import common, line_dedup, substring_dedup, suffix_dedup

PAIRS = [r[:2] for r in corpus()]


def thue_morse(n: int) -> tuple[str, str]:
    x = ["ab"[bin(k).count("1") & 1] for k in range(n)]
    return "".join(x), "".join("ba"["ab".index(c)] for c in x)


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2)


@pytest.mark.parametrize("size", [512, 1024, 2048, 4096])
def test_span_hashes_of_thue_morse_strings(size):
    a, b = thue_morse(size)
    buf = np.frombuffer((a + b).encode(), np.uint8)
    for seed in range(4):
        h = common.SpanHash(seed)
        x, y = h.spans(h.sums(buf), np.array([0, size]), np.array([size, 2 * size]))
        assert x != y
        again = np.frombuffer(("xyz" + b + a).encode(), np.uint8)
        assert h.spans(h.sums(again), np.array([3 + size, 3]), np.array([3 + 2 * size, 3 + size])).tolist() == [x, y]


def test_word_hashes():
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in [*range(1, 40), 64, 65, 200] for _ in range(6)]
    buf = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = common.word_spans(buf, np.array([0, len(buf)]))
    one, two = common.word_hashes(buf, starts, ends)
    assert len(set(one.tolist())) == len(set(two.tolist())) == len(set(words))
    assert len({w: h for w, h in zip(words, one.tolist(), strict=True)}) == len({(w, h) for w, h in zip(words, one.tolist(), strict=True)})


def test_dedup_of_thue_morse_strings(spark):
    a, b = thue_morse(2048)
    rows = [(1, a), (2, b), (3, a), (4, " ".join(["same"] * 12 + [a[:1024]])), (5, " ".join(["same"] * 12 + [b[:1024]])), (6, " ".join(["same"] * 12 + [a[:1024]]))]
    df = rows_of(spark, rows)
    got = line_dedup.line_dedup_counts(df).collect()
    assert sorted(map(tuple, got)) == sorted(brute.lines(rows))
    got = substring_dedup.substring_dedup(df).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256))
    assert tuples(got) == sorted(brute.substrings(rows))
    got = suffix_dedup.suffix_dedup(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert tuples(got) == sorted(brute.suffixes(rows, 400))


def test_hot_segments(spark, monkeypatch):
    """Lines of one stem, in blocks of 3 rows, lose what they lose in one group."""
    monkeypatch.setattr(line_dedup, "BLOCK", 3)
    rng = np.random.default_rng(9)
    rows = [(k, "a common stem of many lines, " + "".join(rng.choice(list("abc"), 5 + k % 3))) for k in range(90)]
    got = line_dedup.line_dedup_counts(rows_of(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(brute.lines(rows)) and 10 < sum(r.n_near for r in got) < 90


def test_segments_stream_through_batches():
    rng = np.random.default_rng(2)
    rows = sorted({(int(s), -(x & 1), int(x)) for s, x in zip(rng.integers(0, 40, 300), rng.integers(2, 60, 300), strict=True)})
    want = []
    for s in {r[0] for r in rows}:
        own = [r[2] for r in rows if r[0] == s]
        if own[0] & 1 and len(own) > 1:
            want += [(s, x, k) for k, x in enumerate(own)]
    for size in (1, 2, 7, 300):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[k : k + size]]), pa.array([r[2] for r in rows[k : k + size]])], ["segment", "line"]) for k in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in line_dedup._met(iter(batches)) for r in b.to_pylist()]
        assert sorted(got) == sorted(want)


@pytest.mark.parametrize("hot", [1, 100_000])
def test_hot_cells(spark, hot):
    """Windows of hot minimisers leave their buckets and lose what they lose there."""
    spans = substring_dedup.repeated_spans(frame(spark), buckets=3000, hot=hot)
    assert ("one" in spans._jdf.queryExecution().analyzed().toString()) == (hot == 1)
    ids = {r._id for r in spans.collect()}
    want = {brute.NO_ID if r[0] is None else r[0] for r in brute.substrings(PAIRS) if r[2]}
    assert {min(i, brute.NO_ID - (1 << 31)) if i > 1 << 60 else i for i in ids} == {min(i, brute.NO_ID - (1 << 31)) for i in want}


def test_hot_cells_remove_the_same(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup.repeated_spans, "__defaults__", (13, 2, 3000, 1))
    got = substring_dedup.substring_dedup(frame(spark)).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256))
    assert tuples(got) == sorted(brute.substrings(PAIRS), key=repr)


def test_windows_of_equal_hashes_are_told_apart():
    words = [b"a", b"b", b"c", b"a", b"b", b"d", b"a", b"b", b"c"]
    buf = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = common.word_spans(buf, np.array([0, len(buf)]))
    at, same = np.array([0, 3, 6]), np.zeros(3, np.uint64)
    assert substring_dedup._later(same, same, np.array([1, 2, 3]), at, (buf, starts, ends), 3).tolist() == [False, False, True]
