"""Queries that run documents through ingestion as files, each with SQL of what comes out."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from inkflow import shared
from inkflow.config import Settings
from inkflow.functions import text as T
from inkflow.operators import catalog, routing
from inkflow.plans import ingest
from inkflow.plans.catalogue import _COVERAGE, _LAYOUT, _STRIPPED, _sampled, query, table
from inkflow.sources import files

#: Characters that XML does not hold.
_CONTROL = r"[\x00-\x09\x0B-\x1F\x7F]"


@F.pandas_udf(BinaryType())
def _as_docx(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A docx with a paragraph for each line."""
    head = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'
    for texts in batches:
        out = []
        for text in texts:
            paragraphs = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in text.split("\n"))
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w") as z:
                z.writestr("word/document.xml", f"{head}{paragraphs}</w:body></w:document>")
            out.append(held.getvalue())
        yield pd.Series(out)


@query(f"""
with t as (select doc_id, list_filter(string_split(regexp_replace(text, '{_CONTROL}', '', 'g'), chr(10)), lambda x: {_STRIPPED.format("x")} <> '') as p from documents)
select doc_id, md5({_STRIPPED.format("array_to_string(p, chr(10))")}) as text, cast(1 as int) as pages from t
""")
def docx_text(spark, sf):
    """Texts as docx files, a paragraph a line, and extracted again."""
    docs = table(spark, sf, "documents").select("doc_id", _as_docx(F.regexp_replace("text", _CONTROL, "")).alias("content"))
    return files.extract_docx(docs).select("doc_id", F.md5("extracted.text").alias("text"), F.col("extracted.pages_processed").alias("pages"))


def _text_files(spark, sf):
    """Documents as text files with metadata; every fifth one has blanks only, every seventh is of an unknown type."""
    name = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 3, ".bin").otherwise(".txt"))
    content = F.encode(F.when(F.col("doc_id") % 5 == 2, " \n ").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.col("text"))), "UTF-8")
    meta = F.to_json(F.struct("lang", F.lit("user").alias("extraction_strategy")))
    return table(spark, sf, "documents").select(name.alias("filename"), T.file_type(name).alias("file_type"), content.alias("content"), meta.alias("metadata"), F.lit(None).cast("timestamp").alias("uploaded_at"))


_READ = "doc_id % 7 <> 3 and doc_id % 5 <> 2"


@query(f"""
select doc_id || '.txt' as filename, 'txt' as file_type, lang, 'local_parser' as strategy, '1' as pages, '0' as captions, true as has_quality, true as has_chunks from documents where {_READ}
""")
def ingested_documents(spark, sf):
    """The documents of ingested files with their metadata: the user's, and the system's, which comes before it."""
    documents, chunks = ingest.ingest(_text_files(spark, sf), stage=shared.new_folder(spark, "stage"))
    own = catalog.with_chunk_counts(documents, chunks)
    value = {k: F.get_json_object("metadata", f"$.{v}") for k, v in (("lang", "lang"), ("strategy", "extraction_strategy"), ("pages", "pages_processed"), ("captions", "image_captions_count"), ("quality", "quality_score"))}
    return own.select("filename", "file_type", value["lang"].alias("lang"), value["strategy"].alias("strategy"), value["pages"].alias("pages"), value["captions"].alias("captions"), value["quality"].cast("double").between(0, 1).alias("has_quality"), (F.col("chunk_count") > 0).alias("has_chunks"))


@query("""
select 'document' as outcome, count(*) as n from documents where doc_id % 7 <> 3 and doc_id % 5 <> 2 union all select 'unknown type', count(*) from documents where doc_id % 7 = 3
union all select 'no text', count(*) from documents where doc_id % 7 <> 3 and doc_id % 5 = 2
""")
def ingested_outcomes(spark, sf):
    """What became of each file: a document, or the reason that it is none."""
    own, stage = _text_files(spark, sf), shared.new_folder(spark, "stage")
    documents, _ = ingest.ingest(own, stage=stage)
    every = documents.select(F.lit("document").alias("outcome")).unionByName(ingest.rejected(own, stage=stage).select(F.col("reason").alias("outcome")))
    return every.groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"""
with {_COVERAGE}, {_LAYOUT}, s as (select doc_id, file_type, case when file_type = 'docx' then 'local_parser' when layout <> 'simple' or page_count >= 5 then 'cloud_ocr' when coverage >= 0.5 then 'local_parser' when coverage < 0.1 then 'local_ocr' else 'hybrid' end as w from x)
select doc_id, w <> 'local_parser' as requires_ocr, file_type = 'pdf' as requires_vision from s
""")
def routing_requirements(spark, sf):
    """What files need by their route, with OCR here and in a cloud."""
    own = routing.route(_sampled(spark, sf), Settings(ocr=True, cloud_ocr=True, cloud_ready=True))
    return own.select("doc_id", "requires_ocr", "requires_vision")


@query("""
select doc_id, cast(lag(doc_id) over (order by doc_id) is null as int) as first, doc_id % 4 <> 1 as kept, case when doc_id % 4 = 2 then '{"v": 2}' else '{}' end as metadata from documents where doc_id % 4 <> 1
""")
def stored_documents(spark, sf):
    """Documents in the catalogue's tables after a delete of a fourth of them and an update of another, read back."""
    prefix = f"stored_{shared.new_folder(spark, 'x').rpartition('-')[2]}_"
    i = F.col("doc_id")
    documents = table(spark, sf, "documents").select(i.cast("string").alias("id"), F.concat(i.cast("string"), F.lit(".txt")).alias("filename"), F.lit("txt").alias("file_type"), F.lit(None).cast("timestamp").alias("uploaded_at"), F.lit("{}").alias("metadata"))
    chunks = table(spark, sf, "documents").select(F.concat(i.cast("string"), F.lit("-0")).alias("id"), i.cast("string").alias("document_id"), F.lit(0).alias("chunk_index"), F.col("text").alias("content"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("array<string>").alias("content_lex"), F.lit("{}").alias("metadata"), F.lit(None).cast("timestamp").alias("created_at"))
    catalog.create_tables(spark, prefix)
    try:
        catalog.append(spark, documents, chunks, prefix)
        number = F.col("id").cast("long") % 4
        catalog.delete_all(spark, documents.filter(number == 1).select("id"), prefix)
        changed = documents.filter(number == 2)
        catalog.upsert(spark, changed.withColumn("metadata", F.lit('{"v": 2}')), chunks.join(changed.select(F.col("id").alias("document_id")), "document_id"), prefix)
        stored = shared.written(catalog.with_chunk_counts(spark.table(f"{prefix}documents"), spark.table(f"{prefix}document_chunks")), "stored")
    finally:
        for name in ("documents", "document_chunks"):
            spark.sql(f"drop table if exists {prefix}{name}")
    least = stored.agg(F.min(F.col("id").cast("long")).alias("_least"))
    both = stored.join(F.broadcast(least)).withColumn("doc_id", F.col("id").cast("long"))
    return both.select("doc_id", (F.col("doc_id") == F.col("_least")).cast("int").alias("first"), (F.col("chunk_count") == 1).alias("kept"), "metadata")
