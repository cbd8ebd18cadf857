"""The catalogue of documents and chunks: pages of documents with counts, look-ups, deletes, backfills, tables.

Parquet has no updates, so what changes a table returns its new rows; the tables are partitioned by a hash of the document, and
deletes and updates rewrite the partitions of their documents alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkflow import shared
from inkflow.functions import json_filter, lexical

DOCUMENTS = "id string, filename string, file_type string, uploaded_at timestamp, metadata string"
CHUNKS = "id string, document_id string, chunk_index int, content string, embedding array<float>, content_lex array<string>, metadata string, created_at timestamp"


def document_id(*parts) -> F.Column:
    """A reproducible id from the parts that name a document."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def with_chunk_counts(documents: DataFrame, chunks: DataFrame, key: str = "id", foreign: str = "document_id") -> DataFrame:
    """documents with chunk_count, 0 for none: one aggregate and one join for all."""
    counts = chunks.groupBy(F.col(foreign).alias(key)).agg(F.count(F.lit(1)).alias("chunk_count"))
    return documents.join(counts, key, "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def page_of_documents(documents: DataFrame, limit: int = 100, offset: int = 0, newest: str = "uploaded_at", key: str = "id") -> DataFrame:
    """A page in the order of time, latest first and unknown times before all; ties by key."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit is 1 to 1000 and offset 0 or more")
    return documents.orderBy(F.col(newest).desc_nulls_first(), F.col(key).asc()).offset(offset).limit(limit)


def listed(documents: DataFrame, chunks: DataFrame, limit: int = 100, offset: int = 0) -> tuple[DataFrame, int]:
    """A page with chunk counts and ISO times, and how many documents there are. Only the page's chunks are counted."""
    page = page_of_documents(documents, limit, offset)
    own = chunks.join(F.broadcast(page.select(F.col("id").alias("document_id"))), "document_id", "left_semi")
    shown = with_chunk_counts(page, own).withColumn("uploaded_at", F.date_format("uploaded_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    return shown, documents.count()


def got(documents: DataFrame, key: str) -> DataFrame:
    return documents.filter(F.col("id") == key)


def deleted(documents: DataFrame, chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the documents of ids (column id) and their chunks."""
    return documents.join(ids, "id", "left_anti"), chunks.join(ids.select(F.col("id").alias("document_id")), "document_id", "left_anti").select(*chunks.columns)


def backfilled(df: DataFrame, defaults: dict[str, F.Column]) -> DataFrame:
    """df with each column there, and its default where it is null."""
    for name, value in defaults.items():
        df = df.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)
    return df


def backfilled_documents(documents: DataFrame) -> DataFrame:
    return backfilled(documents, {"metadata": F.lit("{}")})


def backfilled_chunks(chunks: DataFrame, language: str | None = "spanish") -> DataFrame:
    return backfilled(chunks, {"metadata": F.lit("{}"), "content_lex": lexical.lexemes(F.col("content"), language)})


def null_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(*(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns))


def valid_metadata(df: DataFrame, metadata: str = "metadata") -> tuple[DataFrame, DataFrame]:
    """Rows whose metadata is a JSON object (blank: `{}`), and the rows that are rejected."""
    own = df.withColumn("_own", json_filter.metadata_of(F.col(metadata)))
    return own.filter("_own is not null").withColumn(metadata, F.col("_own")).drop("_own"), own.filter("_own is null").drop("_own")


def built_metadata(**columns: F.Column) -> F.Column:
    """Metadata built of columns, as JSON; nulls are left out."""
    return F.to_json(F.struct(*(c.alias(name) for name, c in columns.items())))


def inherited(chunks: DataFrame, documents: DataFrame, column: str = "metadata", key: str = "id", foreign: str = "document_id") -> DataFrame:
    """chunks with a column's values taken from their documents; those of no document keep theirs."""
    own = documents.select(F.col(key).alias("_key"), F.col(column).alias("_value"))
    joined = chunks.join(own, chunks[foreign] == own["_key"], "left")
    return joined.select(*(F.when(F.col("_key").isNotNull(), F.col("_value")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in chunks.columns))


def aligned(texts: F.Column, vectors: F.Column) -> F.Column:
    """An array of (position, text, vector); the job fails if there are not as many vectors as texts."""
    both = F.arrays_zip(F.transform(texts, lambda x, i: i).alias("position"), texts.alias("text"), vectors.alias("vector"))
    message = F.lit("texts and vectors differ in number")
    return F.when(F.size(texts) == F.size(vectors), both).otherwise(F.raise_error(message).cast("array<struct<position:int,text:string,vector:array<float>>>"))


def responses(df: DataFrame) -> DataFrame:
    """One column `body`: each row as JSON."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("body"))


#: Partitions of the tables, by a hash of the document: what a delete or an update rewrites.
BUCKETS = 64


def bucket(document: Column) -> Column:
    return F.pmod(F.xxhash64(document), F.lit(BUCKETS)).cast("int")


def create_tables(spark: SparkSession, prefix: str = "") -> None:
    for name, schema in (("documents", DOCUMENTS), ("document_chunks", CHUNKS)):
        spark.sql(f"create table if not exists {prefix}{name} ({schema}, bucket int) using parquet partitioned by (bucket)")


def insert(spark: SparkSession, table: str, rows: DataFrame) -> None:
    """Append rows to a table by its column names; rows of documents and chunks go to their document's bucket."""
    columns = spark.table(table).columns
    if "bucket" in columns:
        rows = rows.withColumn("bucket", bucket(F.col("document_id" if "document_id" in columns else "id")))
    rows.select(*columns).write.mode("append").insertInto(table)
    spark.catalog.refreshTable(table)


def append(spark: SparkSession, documents: DataFrame, chunks: DataFrame, prefix: str = "") -> None:
    """Documents go last, so that a document that is listed has its chunks."""
    insert(spark, f"{prefix}document_chunks", chunks)
    insert(spark, f"{prefix}documents", documents)


def replaced(spark: SparkSession, name: str, rows: DataFrame) -> None:
    """Put rows in a table's place; rows may be read from the table itself."""
    rows.write.mode("overwrite").saveAsTable(f"{name}_next")
    spark.sql(f"drop table if exists {name}_before")
    spark.sql(f"alter table {name} rename to {name}_before")
    spark.sql(f"alter table {name}_next rename to {name}")
    spark.sql(f"drop table {name}_before")


def _rewritten(spark: SparkSession, table: str, buckets: list[int], kept: DataFrame) -> None:
    """Put kept in the place of these partitions; others are not touched. kept may be read from the table."""
    staged = shared.written(kept, "kept")
    left = {r.bucket for r in staged.select("bucket").distinct().collect()}
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        staged.select(*spark.table(table).columns).write.mode("overwrite").insertInto(table, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
    for b in sorted(set(buckets) - left):
        spark.sql(f"alter table {table} drop if exists partition (bucket = {b})")
    spark.catalog.refreshTable(table)


def delete_all(spark: SparkSession, ids: DataFrame, prefix: str = "") -> int:
    """Delete the documents of ids (column id) and their chunks; how many documents there were.

    Only the buckets of these documents are read and rewritten, each by one commit that swaps the partition's files.
    Documents go first: if the second step never comes, they are not listed any more, and a repeated call takes out the chunks.
    """
    wanted = shared.written(ids.select("id").distinct(), "ids").withColumn("bucket", bucket(F.col("id")))
    # at most BUCKETS numbers
    buckets = [r.bucket for r in wanted.select("bucket").distinct().collect()]
    if not buckets:
        return 0
    documents, chunks = (spark.table(f"{prefix}{t}").filter(F.col("bucket").isin(buckets)) for t in ("documents", "document_chunks"))
    n = documents.join(wanted.select("id"), "id", "left_semi").count()
    new_documents, new_chunks = deleted(documents, chunks, wanted.select("id"))
    if n:
        _rewritten(spark, f"{prefix}documents", buckets, new_documents)
    if not chunks.join(wanted.select(F.col("id").alias("document_id")), "document_id", "left_semi").isEmpty():
        _rewritten(spark, f"{prefix}document_chunks", buckets, new_chunks)
    return n


def delete(spark: SparkSession, id_: str, prefix: str = "") -> bool:
    """Delete a document and its chunks; False if there is none."""
    return delete_all(spark, spark.createDataFrame([(id_,)], "id string"), prefix) > 0


def upsert(spark: SparkSession, documents: DataFrame, chunks: DataFrame, prefix: str = "") -> None:
    """Put documents and their chunks in the place of those of the same ids, if any."""
    documents, chunks = shared.written(documents, "documents"), shared.written(chunks, "chunks")
    delete_all(spark, documents.select("id"), prefix)
    append(spark, documents, chunks, prefix)
