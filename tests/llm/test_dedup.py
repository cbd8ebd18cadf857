from __future__ import annotations

import numpy as np
import pytest
from fixtures import SCHEMA, corpus, frame, tuples
from pyspark.sql import functions as F

import brute
from inkflow.llm import line_dedup, simhash, substring_dedup, suffix_dedup

ROWS = corpus()
PAIRS = [r[:2] for r in ROWS]


def sorted_rows(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 50, 301])
def test_suffix_array(size):
    for k in range(20):
        x = np.random.default_rng(k).integers(1, 3 + k % 4, size)
        assert suffix_dedup.suffix_array(x).tolist() == sorted(range(size), key=lambda i: x[i:].tolist())


@pytest.mark.parametrize("length,hot", [(400, suffix_dedup.HOT_CLASSES), (150, suffix_dedup.HOT_CLASSES), (400, 2)])
def test_suffix_dedup(spark, monkeypatch, length, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_CLASSES", hot)
    out = suffix_dedup.suffix_dedup(frame(spark), length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert tuples(out) == sorted_rows(brute.suffixes(PAIRS, length))


def test_large_buckets_by_hashes():
    rng = np.random.default_rng(1)
    buf = np.tile(rng.integers(0, 3, 300).astype(np.uint8), 4)
    buf[500] = 9
    starts = np.arange(len(buf) - 100)
    assert np.array_equal(suffix_dedup.repeated_by_suffixes(buf, starts, 100), suffix_dedup.repeated_by_hashes(buf, starts, 100))


def test_substring_dedup(spark):
    out = substring_dedup.substring_dedup(frame(spark)).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256))
    assert tuples(out) == sorted_rows(brute.substrings(PAIRS))


def test_simhash(spark):
    out = simhash.simhash_components(frame(spark)).collect()
    values = [(i, brute.fingerprint(t)) for i, t in PAIRS]
    least = brute.components(values)
    assert sorted_rows((None if r["_id"] == brute.NO_ID else r["_id"], r["fp"] % (1 << 64), r["component_id"]) for r in out) == sorted_rows((i, v, least[v]) for i, v in values)


def test_simhash_keeps_one_of_each_group(spark):
    kept = simhash.simhash_dedup(frame(spark))
    values = [(i, brute.fingerprint(t)) for i, t in PAIRS]
    least = brute.components(values)
    assert kept.columns == frame(spark).columns
    assert sorted((brute.NO_ID if r.doc_id is None else r.doc_id) for r in kept.collect()) == sorted(set(least.values()))


def test_close_values_of_dense_runs(spark, monkeypatch):
    """Chains within the radius and a run beyond DENSE give the same components as comparing all pairs."""
    rng = np.random.default_rng(3)
    values = {0, 3, 15, 63}
    for base in rng.integers(0, 1 << 61, 6, dtype=np.uint64).tolist():
        for _ in range(40):
            values.add(base ^ (1 << int(rng.integers(61))) ^ (1 << int(rng.integers(61))))
    for dense in (simhash.DENSE, 5):
        monkeypatch.setattr(simhash, "DENSE", dense)
        arr = np.array(sorted(values), np.uint64)
        got = simhash._dense_labels(arr, 2) if dense == 5 else None
        if got is not None:
            least = brute.components([(int(v), int(v)) for v in arr])
            assert [int(arr[k]) for k in got] == [least[int(v)] for v in arr]
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    least = brute.components([(v, v) for v in values])
    want: dict[int, set] = {}
    for v in values:
        want.setdefault(least[v], set()).add(v)
    for large in (simhash.LARGE, 3):
        monkeypatch.setattr(simhash, "LARGE", large)
        roots = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(simhash.close_links(df)).collect()}
        groups: dict[int, set] = {}
        for v in values:
            groups.setdefault(roots.get(v, v), set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_within():
    rng = np.random.default_rng(2)
    a = ["".join(rng.choice(list("abc"), rng.integers(1, 12))) for _ in range(400)]
    b = [x[:2] + "".join(rng.choice(list("abc"), rng.integers(0, 3))) + x[3:] for x in a]
    points = np.frombuffer("".join(a + b).encode("utf-32-le"), np.uint32)
    size = np.array([len(x) for x in a + b])
    start = np.cumsum(size) - size
    for k in (1, 2, 3):
        got = line_dedup.within(points, start[:400], size[:400], start[400:], size[400:], k)
        assert got.tolist() == [brute.edit_distance(x, y) <= k for x, y in zip(a, b, strict=True)]


def line_rows():
    rng = np.random.default_rng(4)
    base = ["".join(rng.choice(list("abcdefgh  é"), n)) for n in (29, 30, 31, 40, 55, 90, 33, 34)] + ["日本" * 20]

    def near(x, k):
        x = list(x)
        for _ in range(k):
            at = int(rng.integers(len(x)))
            [lambda: x.insert(at, "z"), lambda: x.pop(at), lambda: x.__setitem__(at, "y")][int(rng.integers(3))]()
        return "".join(x)

    rows = [(0, None), (1, ""), (2, "\n\n \n"), (None, base[3]), (None, base[3]), (5, base[4]), (5, base[4]), (5, base[5])]
    for k in range(10, 60):
        rows.append((k, "\n".join(near(base[int(rng.integers(len(base)))], int(rng.integers(4))) for _ in range(int(rng.integers(1, 6))))))
    return rows


def test_line_dedup(spark):
    rows = line_rows()
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 7, "h", "l") for i, t in rows], SCHEMA).repartition(3)
    got = sorted_rows(tuple(r) for r in line_dedup.line_dedup_counts(df).collect())
    seen, want = set(), []
    for i, exact, near, kept in brute.lines(rows):
        want.append((i, exact, near, kept))
    assert got == sorted_rows(want)
    whole = line_dedup.line_dedup(df)
    assert whole.columns == df.columns
    for r in whole.collect():
        assert r.n_chars == (None if r.text is None else len(r.text)) and r._hash == "h"


def test_line_dedup_of_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()][:120]
    got = sorted_rows(tuple(r) for r in line_dedup.line_dedup_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted_rows(brute.lines(rows))


def test_empty_tables(spark):
    none = frame(spark).limit(0)
    assert suffix_dedup.suffix_dedup(none).collect() == [] == substring_dedup.substring_dedup(none).collect()
    assert simhash.simhash_components(none).collect() == [] == simhash.simhash_dedup(none).collect()
    assert line_dedup.line_dedup(none).collect() == [] == line_dedup.line_dedup_counts(none).collect()
