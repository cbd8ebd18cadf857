"""Hybrid search over stored postings gives the rows of the scan and reads a part of the blocks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from inkflow.operators import lexical_index, retrieval

QUESTIONS = [(1, [0.1] * 4, ["rare1", "w3"]), (2, [0.9, 0.1, 0.0, 0.2], ["w0", "w1", "w0"]), (3, [0.5] * 4, []), (4, [0.0, 1.0, 0.0, 0.0], ["nowhere"]), (5, [0.4, 0.2, 0.9, 0.1], ["w0", "rare2", "w7", "w30"]), (6, None, ["w1"]), (7, [0.3] * 4, None)]


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(2)
    rows = []
    for k in range(400):
        lex = [f"w{min(int(rng.expovariate(0.25)), 40)}" for _ in range(rng.randrange(1, 60))] + ["rare1"] * (k in (7, 300)) * 3 + ["rare2"] * (k % 90 == 0)
        rows.append((k, [rng.random() for _ in range(4)], lex))
    rows += [(400, [0.1] * 4, None), (401, [0.1] * 4, []), (402, None, ["rare1"]), (403, [0.9, 0.1, 0.0, 0.2], ["w0"]), (404, [0.9, 0.1, 0.0, 0.2], ["w0"])]
    return spark.createDataFrame(rows, "id long, embedding array<float>, content_lex array<string>").repartition(3)


@pytest.fixture(scope="module")
def folder(chunks, tmp_path_factory):
    """Two appends, small blocks, and orders of 50 postings, so that common terms have several."""
    path = str(tmp_path_factory.mktemp("postings"))
    for some in (chunks.filter("id < 250"), chunks.filter("id >= 250")):
        lexical_index.append(some, path, block=8, order=50)
    return path


def test_same_rows_as_the_scan(spark, chunks, folder):
    queries = spark.createDataFrame(QUESTIONS, "query_id long, embedding array<float>, terms array<string>")
    found, shares = lexical_index.search(spark, folder, chunks, queries, 6)
    got: dict[int, list] = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, round(r.hybrid_score, 6)))
    for q, vector, terms in QUESTIONS:
        if vector is None:
            assert q not in got
            continue
        scan = retrieval.hybrid_search(chunks.filter("embedding is not null or id < 0").unionByName(chunks.filter("embedding is null")), vector, list(dict.fromkeys(terms or [])), 6).collect()
        assert got[q] == [(r.id, round(r.hybrid_score, 6)) for r in scan]
    read = {r.query_id: (r.read, r.of) for r in shares.collect()}
    assert set(read) == {1, 2, 5} and all(a <= b for a, b in read.values()) and sum(a for a, _ in read.values()) < 0.8 * sum(b for _, b in read.values())


def test_blocks_hold_every_posting_once(spark, chunks, folder):
    blocks = spark.read.parquet(f"{folder}/blocks")
    own = blocks.select("term", F.explode("postings").alias("p")).select("term", "p.key", "p.tf").collect()
    want = {(t, r.id, (r.content_lex or []).count(t)) for r in chunks.collect() for t in set(r.content_lex or [])}
    assert {(r.term, r.key, r.tf) for r in own} == want and len(own) == len(want)
    assert blocks.filter("n > 8").count() == 0 and blocks.filter("part > 0").count() > 0


def test_fewer_chunks_than_asked_for(spark, tmp_path):
    few = spark.createDataFrame([(1, [1.0], ["a"]), (2, [0.0], ["b"])], "id long, embedding array<float>, content_lex array<string>")
    lexical_index.append(few, str(tmp_path))
    queries = spark.createDataFrame([(1, [1.0], ["b"])], "query_id long, embedding array<float>, terms array<string>")
    assert sorted(r.id for r in lexical_index.search(spark, str(tmp_path), few, queries, 5)[0].collect()) == [1, 2]


def test_few_chunks_are_scored_whole(spark, chunks, folder, monkeypatch):
    """At first 3 k chunks a question at most, however many the first blocks hold."""
    counts, own = [], lexical_index._scored
    monkeypatch.setattr(lexical_index, "_scored", lambda candidates, *rest: counts.append(candidates.count()) or own(candidates, *rest))
    queries = spark.createDataFrame([q for q in QUESTIONS if q[0] in (1, 2, 5)], "query_id long, embedding array<float>, terms array<string>")
    lexical_index.search(spark, folder, chunks, queries, 2)
    assert len(counts) == 2 and counts[0] <= 3 * 3 * 2
