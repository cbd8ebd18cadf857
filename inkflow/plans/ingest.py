"""Ingestion: files with metadata to the rows of the documents and chunks tables, one lazy plan for all files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkflow.config import DEFAULTS, Settings
from inkflow.functions import lexical
from inkflow.functions import text as T
from inkflow.functions.embedding import embedded, hashing_embedder
from inkflow.operators import captions, catalog, chunking, routing, structure
from inkflow.sources import files as S
from inkflow.sources.providers import cloud_reader


def extracted(files: DataFrame, settings: Settings = DEFAULTS, pages: DataFrame | None = None) -> DataFrame:
    """files (id, file_type, content, ...) with strategy and `extracted`.

    pages: (id, page_no, text, tables) of parsed pdf files, for their sampling and extraction; without it pdf files need a
    registered provider. Every file gives one row: what needs OCR and has no reader is parsed if its pages are given, and
    a file that no way takes has the error `no reader`.
    """
    pdf = files.filter("file_type = 'pdf'")
    if pages is None and ("pdf", "default") in S.PROVIDERS:
        pages = S.pdf_pages(pdf, "id")
    coverage, confidence = routing.sample_defaults(F.col("file_type"))
    others = files.filter("file_type <> 'pdf'").withColumns({"page_count": F.lit(1), "coverage": coverage, "confidence": confidence, "sample": F.lit("")})
    if pages is not None:
        sampled = pdf.join(routing.text_coverage(pages, "id"), "id", "left")
        sampled = sampled.withColumns({"page_count": F.coalesce("page_count", F.lit(1)), "coverage": F.coalesce("coverage", F.lit(0.0)), "confidence": F.coalesce("confidence", F.lit(0.0)), "sample": F.coalesce("sample", F.lit(""))})
    else:
        sampled = pdf.withColumns({"page_count": F.lit(1), "coverage": F.lit(0.0), "confidence": F.lit(0.0), "sample": F.lit("")})
    routed = routing.route(others.unionByName(sampled), settings)

    def of(*types: str, way=F.lit(True)) -> DataFrame:
        return routed.filter(F.col("file_type").isin(*types) & way)

    parts = [S.extract_text(of("txt")), S.extract_html(of("html")), S.extract_docx(of("docx"))]
    by_ocr = F.col("strategy").isin(routing.LOCAL_OCR, routing.CLOUD_OCR)
    local = S.PROVIDERS.get(("ocr", "default"))
    cloud = cloud_reader(settings.cloud) if settings.cloud_available and settings.cloud else None
    reads = bool(settings.ocr and (local or cloud))
    left = F.lit(True)
    if pages is not None:
        parsed = S.pages_text(pages, "id")
        own = ~by_ocr if reads else F.lit(True)
        parts.append(S.without_pages(of("pdf", way=own).join(parsed, "id", "left")))
        left = left & ~((F.col("file_type") == "pdf") & own)
    if reads:
        parts.append(S.extract_ocr(of("pdf", *routing.IMAGES, way=by_ocr), local, cloud, F.col("strategy") == routing.CLOUD_OCR))
        left = left & ~by_ocr
    parts.append(S.unread(routed.filter(~F.col("file_type").isin("txt", "html", "docx") & left)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def identified(files: DataFrame) -> DataFrame:
    """files with `id`, which documents and captions go by: a digest of the name and the content."""
    return files.withColumn("id", catalog.document_id("filename", F.sha2("content", 256)))


def _read_once(files: DataFrame, settings: Settings, pages: DataFrame | None, stage: str | None) -> DataFrame:
    """The extracted rows without content; written to `stage` and read back if it is given."""
    named = catalog.valid_metadata(S.accepted(identified(files))[0])[0]
    whole = extracted(named, settings, pages).drop("content")
    if stage is None:
        return whole
    whole.write.mode("overwrite").parquet(stage)
    return files.sparkSession.read.parquet(stage)


def _full(text: Column) -> Column:
    return F.length(T.strip(F.coalesce(text, F.lit("")))) > 0


def rejected(files: DataFrame, settings: Settings = DEFAULTS, pages: DataFrame | None = None, stage: str | None = None) -> DataFrame:
    """id, filename and reason of the files that give no rows: unknown type, metadata that is no JSON object, the error of
    the extraction, or no text. stage: the folder that `ingest` has written, so that nothing is extracted again."""
    known, unknown = S.accepted(identified(files))
    good, bad = catalog.valid_metadata(known)
    whole = files.sparkSession.read.parquet(stage) if stage else extracted(good, settings, pages)
    empty = whole.filter(~_full(F.col("extracted.text"))).select("id", "filename", F.coalesce("extracted.error", F.lit("no text")).alias("reason"))
    other = unknown.select("id", "filename", F.lit("unknown type").alias("reason")).unionByName(bad.select("id", "filename", F.lit("metadata is no object").alias("reason")))
    return other.unionByName(empty)


def ingest(
    files: DataFrame, settings: Settings = DEFAULTS, model: Callable | None = None, image_captions: DataFrame | None = None, pages: DataFrame | None = None, language: str | None = "spanish", stage: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) from files (filename, file_type, uploaded_at, content, metadata as JSON text).

    image_captions: (id, ordinal, page, caption) by the ids of `identified`; with filename in place of id, which must then be
    unique. stage: a folder for the extracted rows; both results read it, and providers are called once for each file.
    Files that `rejected` tells of give no rows.
    """
    docs = _read_once(files, settings, pages, stage).withColumn("text", F.col("extracted.text")).filter(_full(F.col("text")))
    if image_captions is not None and settings.ocr:
        by = "id" if "id" in image_captions.columns else "filename"
        docs = captions.injected(docs, image_captions, by, wanted=routing.captions_wanted(F.col("file_type"), F.col("strategy"), settings), count="n_captions")
    else:
        docs = docs.withColumn("n_captions", F.lit(0))
    docs = docs.withColumn("text", T.clean_tables(F.col("text"), settings.strict_parity))
    shaped = structure.structure(docs, *(c for c in docs.columns if c != "text"))
    system = F.create_map(
        F.lit("extraction_strategy"), F.col("strategy"), F.lit("quality_score"), F.col("quality_score").cast("string"), F.lit("pages_processed"), F.col("extracted.pages_processed").cast("string"),
        F.lit("image_captions_count"), F.coalesce("n_captions", F.lit(0)).cast("string"),
    )
    shaped = shaped.withColumn("_meta", T.merged_metadata(_raw_entries("metadata"), _as_json(system, ("extraction_strategy",))))
    documents = shaped.select("id", "filename", "file_type", "uploaded_at", _json("_meta").alias("metadata"))

    chunks = chunking.semantic_chunks(shaped, "id", most=settings.chunk_max_tokens, overlap=settings.chunk_overlap, tables=settings.preserve_tables)
    pieces = chunking.split_for_embedding(chunks.withColumnRenamed("id", "document_id"), most=settings.embedding_max_tokens)
    own = F.create_map(
        F.lit("sections"), F.col("sections").cast("string"), F.lit("has_table"), F.col("has_table").cast("string"), F.lit("has_heading"), F.col("has_heading").cast("string"),
        F.lit("section"), F.col("section"), F.lit("tokens"), F.col("tokens").cast("string"),
    )
    split = F.when(F.col("is_split"), F.create_map(F.lit("is_split"), F.lit("true"), F.lit("original_chunk_index"), F.col("original_chunk_index").cast("string"), F.lit("split_index"), F.col("split_index").cast("string")))
    joined = pieces.join(shaped.select(F.col("id").alias("document_id"), "_meta"), "document_id")
    joined = joined.withColumn("_meta", T.merged_metadata(F.col("_meta"), _as_json(own, ("section",)), split))
    rows = joined.select(
        catalog.document_id("document_id", F.col("original_chunk_index").cast("string"), F.col("split_index").cast("string")).alias("id"), "document_id", F.col("chunk_index").cast("int").alias("chunk_index"), "content",
        embedded(F.col("content"), model or hashing_embedder()).alias("embedding"), lexical.lexemes(F.col("content"), language).alias("content_lex"), _json("_meta").alias("metadata"), F.current_timestamp().alias("created_at"),
    )
    return documents, rows


def _raw_entries(metadata: str):
    """A JSON object's keys with their values as JSON text."""
    own = F.from_json(F.col(metadata), "map<string,variant>")
    return F.transform_values(own, lambda _, v: F.to_json(v))


def _as_json(values, strings: tuple[str, ...]):
    """A map's values as JSON text: those of `strings` quoted, others as they are."""
    quoted = F.transform_values(values, lambda k, v: F.when(k.isin(*strings), F.to_json(F.array(v))).otherwise(F.concat(F.lit("["), v, F.lit("]"))))
    return F.transform_values(quoted, lambda _, v: F.substring(v, F.lit(2), F.length(v) - 2))


def _json(entries: str):
    """A map of JSON texts as one JSON object."""
    parts = F.transform(F.map_entries(entries), lambda e: F.concat(F.regexp_extract(F.to_json(F.array(e["key"])), r"(?s)^\[(.*)\]$", 1), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))
