"""The index of metadata gives the rows that the containment filter gives, and reads the lists it needs."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from inkflow.functions import json_filter
from inkflow.operators import metadata_index as M


def documents(n: int = 300) -> list[tuple[int, str | None]]:
    rng = random.Random(4)
    rows: list[tuple[int, str | None]] = []
    for k in range(n):
        own = {"lang": "es" if k % 10 else rng.choice(["en", "de"]), "n": k % 40, "tags": [f"t{k % 7}", {"x": k % 5}, [k % 3]], "a": {"b": {"c": k % 11, "d": None if k % 2 else True}}, "f": k / 4, "e": [] if k % 3 else {}}
        rows.append((k, json.dumps(own)))
    odd = ["{}", "[]", "[1, 2]", "5", "null", '"x"', "", None, "no json", '{"n": 3} tail', '{"n": 1e400}', '{"n": 3.0, "lang": "es"}', '{"k": 1, "k": 2}', '{"tags": []}', '{"quote\'s": "a\\u0000b"}', '{"n": NaN}', '{"n": 9007199254740993}', '{"n": -0.0}', '{"deep":' * 400 + "1" + "}" * 400]
    return rows + [(n + k, t) for k, t in enumerate(odd)]


FILTERS = [
    {"lang": "en"}, {"lang": "es"}, {"n": 3}, {"n": 3.0}, {"n": 0}, {"n": "3"}, {"tags": ["t3"]}, {"tags": [{"x": 2}, "t1"]}, {"tags": [[1]]}, {"tags": []}, {"a": {"b": {"c": 4}}}, {"a": {"b": {"d": None}}}, {"a": {}}, {"e": {}}, {"e": []},
    {"f": 2.5, "lang": "es"}, {"n": 9007199254740993}, {"n": 9007199254740992}, {"z": 1}, {"quote's": "a\x00b"}, {"a": {"b": {"c": 4, "d": True}}, "tags": ["t2"]}, {"lang": None}, {}, None,
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two appends."""
    path = str(tmp_path_factory.mktemp("index"))
    rows = documents()
    for some in (rows[:200], rows[200:]):
        M.append(spark.createDataFrame(some, "id long, metadata string").withColumn("other", F.col("id") * 2), path)
    return path


@pytest.mark.parametrize("filters", FILTERS, ids=str)
def test_same_rows_as_the_filter(spark, folder, filters):
    every = spark.createDataFrame(documents(), "id long, metadata string")
    want = sorted(r.id for r in json_filter.filtered(every, filters).collect())
    got = M.filtered(spark, folder, filters)
    assert got.columns == ["id", "metadata", "other"]
    assert sorted(r.id for r in got.collect()) == want


def test_only_the_lists_and_parts_of_a_filter_are_read(spark, folder):
    got = M.filtered(spark, folder, {"n": 7, "lang": "es"})
    plan = got._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet[^\n]*", plan)
    lists = next(s for s in scans if "postings" in s)
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ IN \([\d,]+\)|PartitionFilters: \[[^\]]*bucket#\d+ = \d+", lists) and "term" in re.search(r"PushedFilters: \[(.*?)\], ReadSchema", lists)[1]
    rows = next(s for s in scans if "/rows" in s)
    assert re.search(r"PartitionFilters: \[[^\]]*part#\d+", rows)
    parts = {r.part for r in M.candidates(spark, folder, M.plan_of(spark, folder, {"n": 7, "lang": "es"})).collect()}
    assert 0 < len(parts) < M.PARTS
    # the list of "es", which most rows are in, is not read
    assert len(M.plan_of(spark, folder, {"n": 7, "lang": "es"})) < len(M.terms_of({"n": 7, "lang": "es"}))
    assert M.plan_of(spark, folder, {"lang": "es"}) is None


def test_compact(spark, folder, tmp_path):
    M.compact(spark, folder, str(tmp_path))
    for filters in FILTERS[:12]:
        assert sorted(r.id for r in M.filtered(spark, str(tmp_path), filters).collect()) == sorted(r.id for r in M.filtered(spark, folder, filters).collect())
    assert M.common_terms(spark, folder, 3).count() == 3
