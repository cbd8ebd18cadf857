"""Exact dedup by a stateful stream against a plain version."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from fixtures import corpus, frame, tuples
from pyspark.sql import functions as F

from inkflow.llm import exact_dedup

COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def plain(rows) -> list[tuple]:
    """rows: (doc_id, text, file, row)."""
    groups = defaultdict(list)
    for i, t, file, row in rows:
        t = t or ""
        groups[re.sub(r"[\x20\x09-\x0D]+", "", t)].append((-len(t), i is None, i or 0, file, row, i))
    out = []
    for text, members in groups.items():
        best = min(members)
        out += [(m[-1], best[-1], len(members), m == best, hashlib.sha256(text.encode()).hexdigest()) for m in members]
    return sorted(out, key=repr)


def stored(spark, path):
    """doc_id, text and locator of the files of a folder, as Spark tells them."""
    df = spark.read.parquet(path)
    at = df.metadataColumn("_metadata")
    return df.select("doc_id", "text", at["file_path"], at["row_index"]).collect()


ODD = [(None, None), (None, ""), (1, " a\tb\nc\x0b\x0cd\r"), (2, "abcd"), (2, "abcd"), (2, "abcd  "), (3, "a b c"), (3, "ab c"), (4, "É\U0001f600 x"), (5, "É\U0001f600x"), (6, "a\x00b"), (7, "x y" * 40_000), (8, "xy" * 40_000)]


def test_against_plain(spark, tmp_path):
    path = str(tmp_path / "docs")
    frame(spark).write.parquet(path)
    exact_dedup.update(spark, path, str(tmp_path / "state"))
    got = exact_dedup.exact_dedup(spark, path, str(tmp_path / "state"))
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())
    assert tuples(got.select(*COLUMNS)) == plain(stored(spark, path))


def test_later_files_meet_the_state(spark, tmp_path):
    """New files are the only ones read; their rows can take a group's place; a second call reads nothing."""
    path, state = str(tmp_path / "docs"), str(tmp_path / "state")
    rows = [r[:2] for r in corpus(9)] + ODD
    spark.createDataFrame(rows[::2], "doc_id long, text string").repartition(2).write.parquet(path)
    assert exact_dedup.update(spark, path, state) == len(rows[::2])
    spark.createDataFrame(rows[1::2] + rows[:20], "doc_id long, text string").repartition(2).write.mode("append").parquet(path)
    assert exact_dedup.update(spark, path, state) == len(rows[1::2]) + 20
    assert exact_dedup.update(spark, path, state) == 0
    for most in (0, 1000):
        assert tuples(exact_dedup.exact_dedup(spark, path, state, broadcast_rows=most).select(*COLUMNS)) == plain(stored(spark, path))


def test_digests_that_meet_are_told_apart_by_their_bytes(spark, tmp_path):
    def weak(text):
        return (F.crc32(text) % 5).cast("string")

    path, state = str(tmp_path / "docs"), str(tmp_path / "state")
    spark.createDataFrame([r[:2] for r in corpus(3)] + ODD, "doc_id long, text string").repartition(3).write.parquet(path)
    exact_dedup.update(spark, path, state, weak)
    assert exact_dedup.index(spark, state).count() <= 5
    assert tuples(exact_dedup.exact_dedup(spark, path, state, weak).select(*COLUMNS)) == plain(stored(spark, path))


def test_batches_of_a_few_files_and_names_that_clash(spark, tmp_path):
    path, state = str(tmp_path / "docs"), str(tmp_path / "state")
    spark.createDataFrame([(k % 7, f"t {k % 5}", "clash", k, "x") for k in range(40)], "doc_id int, text string, _metadata string, n long, key string").repartition(4).write.parquet(path)
    exact_dedup.update(spark, path, state, batch_bytes=1)
    assert spark.read.parquet(f"{state}/changes").filter("batch >= 0").select("batch").distinct().count() == 4
    got = exact_dedup.exact_dedup(spark, path, state)
    at = spark.read.schema("doc_id int, text string").parquet(path)
    rows = at.select("doc_id", "text", at.metadataColumn("_metadata")["file_path"], at.metadataColumn("_metadata")["row_index"]).collect()
    assert tuples(got.select(*COLUMNS)) == plain(rows)


def test_empty_table(spark, tmp_path):
    path, state = str(tmp_path / "docs"), str(tmp_path / "state")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(path)
    assert exact_dedup.update(spark, path, state) == 0
    assert exact_dedup.exact_dedup(spark, path, state).collect() == []
