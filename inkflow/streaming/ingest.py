"""Ingestion as a stream: each new file of a folder becomes a document and its chunks, or a row of the rejects, once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkflow.config import DEFAULTS, Settings
from inkflow.operators import catalog
from inkflow.plans.ingest import identified, ingest, rejected
from inkflow.sources.files import described

_FILES = "path string, modificationTime timestamp, length long, content binary"
REJECTS = "id string, filename string, reason string, batch long"
LEDGER = "path string, id string, batch long, outcome string"
#: A file of this name beside a file holds its metadata, a JSON object.
SIDE = ".meta.json"


def described_beside(spark: SparkSession, files: DataFrame, folder: str, metadata: str) -> DataFrame:
    """files with `metadata`: the side file's text, else `metadata`. Side files are read by their names alone."""
    side = spark.read.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{SIDE}").load(folder)
    texts = side.select(F.regexp_replace("path", r"\.meta\.json$", "").alias("path"), F.decode("content", "UTF-8").alias("_side"))
    own = described(files.filter(~F.endswith(F.col("path"), F.lit(SIDE)))).join(texts, "path", "left")
    return own.withColumn("metadata", F.coalesce("_side", F.lit(metadata))).drop("_side")


def _absent(rows: DataFrame, table: DataFrame, ids: DataFrame, key: str = "id", of: str = "id") -> DataFrame:
    """The rows whose key the table does not hold. Of the table only rows that belong to this batch's documents are compared."""
    there = table.join(F.broadcast(ids.select(F.col("id").alias(of))), of, "left_semi").select(key).distinct()
    return rows.join(there, key, "left_anti")


def ingest_stream(spark: SparkSession, folder: str, checkpoint: str, prefix: str = "", metadata: str = "{}", settings: Settings = DEFAULTS, language: str | None = "spanish", most_files: int = 10_000) -> StreamingQuery:
    """Append the files that are in the folder and not ingested yet to the tables, then stop.

    Tables, all under the prefix: documents and document_chunks; rejects (id, filename, reason, batch) of files that gave no
    document; ingested_files (path, id, batch, outcome: `document`, or the reason), one row for each file of the folder. Files
    of one name and content are one document, or one reject, and each has its row of the ledger. `name.ext.meta.json` beside
    `name.ext` gives it metadata of its own in place of `metadata`.

    A batch, of at most `most_files` files, that is run again after a failure adds nothing twice: rows whose id is there are not appended, the ledger last.
    Each batch overwrites the extracted rows of the one before in a folder of the checkpoint.
    """
    catalog.create_tables(spark, prefix)
    for name, schema in (("rejects", REJECTS), ("ingested_files", LEDGER)):
        spark.sql(f"create table if not exists {prefix}{name} ({schema}) using parquet")

    def batch(files: DataFrame, number: int) -> None:
        own, stage = files.sparkSession, f"{checkpoint}/extracted"
        every = identified(described_beside(own, files, folder, metadata))
        listed = every.select("path", "id", "filename")
        one = every.dropDuplicates(["id"])
        documents, chunks = ingest(one, settings, language=language, stage=stage)
        bad = rejected(one, settings, stage=stage).withColumn("batch", F.lit(number).cast("long"))
        # at most most_files ids
        ids = listed.select("id").distinct()
        new_documents = _absent(documents, own.table(f"{prefix}documents"), ids)
        new_chunks = _absent(chunks, own.table(f"{prefix}document_chunks"), ids, of="document_id")
        catalog.append(own, new_documents, new_chunks, prefix)
        catalog.insert(own, f"{prefix}rejects", _absent(bad, own.table(f"{prefix}rejects"), ids))
        outcome = listed.join(bad.select("id", "reason"), "id", "left").select("path", "id", F.lit(number).cast("long").alias("batch"), F.coalesce("reason", F.lit("document")).alias("outcome"))
        known = own.table(f"{prefix}ingested_files").filter(F.col("batch") == number).select("path")
        catalog.insert(own, f"{prefix}ingested_files", outcome.join(known, "path", "left_anti"))
        for name in ("documents", "document_chunks", "rejects", "ingested_files"):
            spark.catalog.refreshTable(f"{prefix}{name}")

    source = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most_files).load(folder)
    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
