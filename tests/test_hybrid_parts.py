"""Hybrid search by parts: rows of blocks do not grow with the questions, and each of its narrower readings gives the scan's rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from inkflow.operators import lexical_index, retrieval

QUESTIONS = [(q, [0.1 * q, 0.5, 0.2], [f"w{q}", "w0", f"w{q + 9}"]) for q in range(6)]


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(5)
    rows = [(k, [rng.random() for _ in range(3)], [f"w{min(int(rng.expovariate(0.2)), 30)}" for _ in range(rng.randrange(1, 40))]) for k in range(200)]
    return spark.createDataFrame(rows, "id long, embedding array<float>, content_lex array<string>").repartition(2)


def asked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, embedding array<float>, terms array<string>")


def found(rows) -> dict[int, list]:
    out: dict[int, list] = {}
    for r in rows.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, round(r.hybrid_score, 6)))
    return out


def test_rows_of_blocks_do_not_grow_with_questions(spark, chunks, tmp_path, monkeypatch):
    lexical_index.append(chunks, str(tmp_path), block=8)
    own, counts = lexical_index.shared.written, []
    monkeypatch.setattr(lexical_index.shared, "written", lambda df, name="rows": counts.append(df.count()) or own(df, name) if name == "heads" else own(df, name))
    once = found(lexical_index.search(spark, str(tmp_path), chunks, asked(spark, QUESTIONS[:1]), 3)[0])
    many = found(lexical_index.search(spark, str(tmp_path), chunks, asked(spark, [(100 + k, *QUESTIONS[0][1:]) for k in range(20)]), 3)[0])
    assert counts[0] == counts[1] > 0 and all(own == once[0] for own in many.values())


@pytest.mark.parametrize("name, value", [("MANY", 0), ("QUESTION_BLOCK", 2), ("WORDS", 60), ("FIRST", 1), ("FEW_KEYS", 0)])
def test_same_rows_as_the_scan(spark, chunks, tmp_path, monkeypatch, name, value):
    monkeypatch.setattr(lexical_index, name, value)
    lexical_index.append(chunks, str(tmp_path), block=4, order=60)
    got = found(lexical_index.search(spark, str(tmp_path), chunks, asked(spark, QUESTIONS), 5)[0])
    for q, vector, terms in QUESTIONS:
        assert got[q] == [(r.id, round(r.hybrid_score, 6)) for r in retrieval.hybrid_search(chunks, vector, list(dict.fromkeys(terms)), 5).collect()]


def test_append_that_failed_is_called_again(spark, chunks, tmp_path):
    """Without its sizes an append does not count; the next one takes its place."""
    folder = str(tmp_path)
    lexical_index.append(chunks.filter("id < 100"), folder)
    (tmp_path / "sizes").rename(tmp_path / "lost")
    lexical_index.append(chunks, folder)
    blocks = spark.read.parquet(f"{folder}/blocks").select("term", F.explode("postings").alias("p"))
    assert blocks.count() == blocks.select("term", "p.key").distinct().count() == chunks.select("id", F.explode("content_lex")).distinct().count()
