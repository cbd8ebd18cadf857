"""Deletes and updates rewrite the buckets of their documents and nothing else, and can be run again."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inkflow.operators import catalog

NAMES = ("b_documents", "b_document_chunks")


@pytest.fixture
def tables(spark):
    for t in NAMES:
        spark.sql(f"drop table if exists {t}")
    catalog.create_tables(spark, "b_")
    documents = spark.range(40).select(F.col("id").cast("string").alias("id"), F.concat(F.col("id"), F.lit(".txt")).alias("filename"), F.lit("txt").alias("file_type"), F.lit(None).cast("timestamp").alias("uploaded_at"), F.lit("{}").alias("metadata"))
    chunks = documents.select(F.concat("id", F.lit("-0")).alias("id"), F.col("id").alias("document_id"), F.lit(0).alias("chunk_index"), F.lit("old").alias("content"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("array<string>").alias("content_lex"), "metadata", F.lit(None).cast("timestamp").alias("created_at"))
    catalog.append(spark, documents, chunks, "b_")
    yield documents, chunks
    for t in NAMES:
        spark.sql(f"drop table if exists {t}")


def files(spark, table) -> dict[int, set[str]]:
    out: dict[int, set[str]] = {}
    for r in spark.table(table).select("bucket", F.input_file_name().alias("f")).distinct().collect():
        out.setdefault(r.bucket, set()).add(r.f)
    return out


def ids(spark, table="b_documents", column="id") -> set[str]:
    return {r[0] for r in spark.table(table).select(column).collect()}


def test_one_bucket_is_rewritten(spark, tables):
    before = {t: files(spark, t) for t in NAMES}
    own = spark.range(1).select(catalog.bucket(F.lit("7"))).first()[0]
    assert catalog.delete(spark, "7", "b_") and not catalog.delete(spark, "7", "b_")
    for t in NAMES:
        after = files(spark, t)
        assert {b: f for b, f in after.items() if b != own} == {b: f for b, f in before[t].items() if b != own}
    assert ids(spark) == ids(spark, "b_document_chunks", "document_id") == {str(k) for k in range(40) if k != 7}


def test_a_delete_that_stops_half_way_is_ended_by_the_next(spark, tables, monkeypatch):
    real = catalog._rewritten

    def stops(spark, table, *rest):
        if table.endswith("chunks"):
            raise RuntimeError("lost")
        real(spark, table, *rest)

    monkeypatch.setattr(catalog, "_rewritten", stops)
    with pytest.raises(RuntimeError):
        catalog.delete(spark, "3", "b_")
    assert "3" not in ids(spark) and "3" in ids(spark, "b_document_chunks", "document_id")
    monkeypatch.setattr(catalog, "_rewritten", real)
    assert not catalog.delete(spark, "3", "b_")
    assert "3" not in ids(spark, "b_document_chunks", "document_id")


def test_many_and_updates(spark, tables):
    documents, chunks = tables
    assert catalog.delete_all(spark, spark.createDataFrame([("1",), ("2",), ("2",), ("none",)], "id string"), "b_") == 2
    assert len(ids(spark)) == 38
    new = documents.filter("id in ('5', '1')").withColumn("metadata", F.lit('{"v": 2}'))
    catalog.upsert(spark, new, chunks.filter("document_id in ('5', '1')").withColumn("content", F.lit("new")), "b_")
    assert len(ids(spark)) == 39 == spark.table("b_documents").count()
    assert {r.document_id for r in spark.table("b_document_chunks").filter("content = 'new'").collect()} == {"1", "5"}
    assert catalog.delete_all(spark, spark.table("b_documents").select("id"), "b_") == 39
    assert spark.table("b_documents").count() == 0 == spark.table("b_document_chunks").count()
