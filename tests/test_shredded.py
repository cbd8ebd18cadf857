"""Shredded metadata gives the rows of the containment filter, and hot keys prune partitions and row groups."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F
from test_metadata_index import FILTERS, documents

from inkflow.functions import json_filter
from inkflow.operators import shredded

HOT = {"lang": "string", "n": "double", "z": "boolean"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("shredded"))
    shredded.write(spark.createDataFrame(documents(), "id long, metadata string"), HOT, path, ["lang"], files=4)
    return path


def test_same_rows_as_the_filter(spark, folder):
    every = spark.createDataFrame(documents(), "id long, metadata string").cache()
    rows = spark.read.parquet(folder)
    own = [f for f in FILTERS if f] + [{"n": 9007199254740993, "lang": "es"}, {"lang": 5}, {"z": True}, {"n": True}]
    # one scan for all filters on either side
    want = every.select("id", *(json_filter.contains(json_filter.parsed(F.col("metadata")), f).alias(f"_{k}") for k, f in enumerate(own))).collect()
    got = rows.select("id", *(F.coalesce(shredded.condition(f, HOT), F.lit(False)).alias(f"_{k}") for k, f in enumerate(own))).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert shredded.filtered(rows, {}, HOT).count() == every.count() == shredded.filtered(rows, None, HOT).count()


def test_hot_keys_reach_the_scan(spark, folder):
    plan = shredded.filtered(spark.read.parquet(folder), {"lang": "en", "n": 7, "tags": ["t3"]}, HOT).select("id")._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan" in x)
    assert "meta_lang" in re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", scan)[1]
    assert "EqualTo(meta_n,7.0)" in re.search(r"PushedFilters: \[(.*?)\], ReadSchema", scan)[1]
    assert "parse_json" not in plan


def test_files_hold_ranges_of_hot_values(spark, folder):
    found = spark.read.parquet(folder).filter("meta_lang = 'es' and meta_n is not null").groupBy(F.input_file_name().alias("f")).agg(F.min("meta_n").alias("a"), F.max("meta_n").alias("b")).orderBy("a").collect()
    assert len(found) > 1 and all(x.b <= y.a for x, y in zip(found, found[1:], strict=False))


def test_kinds(spark):
    with pytest.raises(ValueError, match="string, double or boolean"):
        shredded.shred(spark.createDataFrame([], "id int, metadata string"), {"a": "date"})
    assert shredded.shred(spark.createDataFrame([], "id int, metadata string"), HOT).columns == ["id", "variant", "meta_lang", "meta_n", "meta_z"]
