"""Rows that share a doc_id, or have none, are told apart by their texts."""

from __future__ import annotations

import random

from fixtures import frame, words

from inkflow.llm import decontamination, simhash


def full(rows):
    return [(i, t, "en", "s", None if t is None else len(t), 7, "h", "l") for i, t in rows]


def pairs(df) -> list[tuple]:
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_simhash_dedup(spark):
    rng = random.Random(4)
    t = [" ".join(words(rng, 60, 10**6)) for _ in range(6)]
    rows = [(None, t[0]), (None, t[1]), (None, t[1]), (7, t[2]), (7, t[3]), (9, t[3]), (None, t[5]), (1, t[5])]
    want = [(None, t[0]), (None, t[1]), (7, t[2]), (7, t[3]), (1, t[5])]
    assert pairs(simhash.simhash_dedup(frame(spark, full(rows)))) == sorted(want, key=repr)


def test_decontaminate(spark):
    rng = random.Random(6)
    item = " ".join(words(rng, 40, 10**6))
    t = [" ".join(words(rng, 60, 10**6)) for _ in range(4)]
    rows = [(None, t[0] + " " + item), (None, t[1]), (7, item + " " + t[2]), (7, t[3]), (8, None), (7, None)]
    items = spark.createDataFrame([(0, item)], "item_id long, text string")
    want = [(None, t[1]), (7, t[3]), (8, None), (7, None)]
    assert pairs(decontamination.decontaminate(frame(spark, full(rows)), items)) == sorted(want, key=repr)
