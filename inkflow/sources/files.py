"""Files as rows: listing, type, decoded text, and extraction by type.

Binary parsers run per row in pandas UDFs where Spark read the file; engines that are not here (PDF, OCR, captions) are
providers, functions that are looked up by name when a job is built.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from inkflow.functions import text as T
from inkflow.sources import html

TABLES = "array<array<array<string>>>"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

#: Providers by kind and name: a page reader takes bytes and gives (page texts, tables per page), a reader of OCR takes
#: bytes and a type and gives page texts, a captioner takes image bytes and gives text, and so on.
PROVIDERS: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str, provider: Callable) -> None:
    PROVIDERS[kind, name] = provider


def provider(kind: str, name: str) -> Callable:
    if (kind, name) not in PROVIDERS:
        raise ValueError(f"no {kind} provider named {name}; register one")
    return PROVIDERS[kind, name]


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, filename, file_type, uploaded_at, length, content of each file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return described(files)


def described(files: DataFrame) -> DataFrame:
    name = F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))
    own = files.withColumn("filename", name)
    return own.select("path", "filename", T.file_type(F.col("filename")).alias("file_type"), F.col("modificationTime").alias("uploaded_at"), "length", "content")


def accepted(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files of known types, and the others for a quarantine."""
    kind = F.coalesce("file_type", F.lit("unknown"))
    return files.filter(kind != "unknown"), files.filter(kind == "unknown")


def docx_parts(content: bytes) -> tuple[list[str], list[list[list[str]]]]:
    """The paragraphs outside tables that are not blank, and the tables as rows of cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")

    def text(node) -> str:
        marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
        return "".join(x.text or "" if x.tag == f"{_W}t" else marks.get(x.tag, "") for x in node.iter())

    paragraphs = [t for p in body.findall(f"{_W}p") if (t := text(p)).strip()]
    tables = [[["\n".join(text(p) for p in cell.findall(f"{_W}p")) for cell in row.findall(f"{_W}tc")] for row in table.findall(f"{_W}tr")] for table in body.findall(f"{_W}tbl")]
    return paragraphs, tables


def readable(content: bytes | None) -> tuple[list[str], list[list[list[str]]], str | None]:
    """docx_parts and no error; for a file that is no docx nothing and the error, so that others go on."""
    try:
        return (*docx_parts(content), None) if content is not None else ([], [], "no content")
    except (zipfile.BadZipFile, KeyError, AttributeError, ElementTree.ParseError, EOFError, zlib.error) as e:
        return [], [], _named(e)


def _named(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"[:200]


def _extracted(text: Column, tables: Column | None = None, pages: Column | None = None, confidence: Column | None = None, error: Column | None = None) -> Column:
    """What every way of extraction gives; a file that could not be read has an error and no text."""
    none = F.array().cast(TABLES)
    return F.struct(
        text.alias("text"), F.coalesce(tables, none).alias("tables") if tables is not None else none.alias("tables"), (F.lit(1) if pages is None else pages).alias("pages_processed"),
        (F.lit(1.0) if confidence is None else confidence).alias("confidence"), (F.lit(None) if error is None else error).cast("string").alias("error"),
    )


@F.pandas_udf(StructType([*html.TEXT_AND_TABLES.fields, StructField("error", StringType())]))
def _docx(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for contents in batches:
        parts = [readable(c) for c in contents]
        yield pd.DataFrame({"text": ["\n".join(p) for p, _, _ in parts], "tables": [t for _, t, _ in parts], "error": pd.Series([e for _, _, e in parts], dtype=object)})


def extract_docx(files: DataFrame) -> DataFrame:
    """files with `extracted`: paragraphs, then each table under a mark."""
    own = files.withColumn("_x", _docx("content"))
    tables = F.transform("_x.tables", T.format_table)
    marked = F.transform(F.filter(tables, lambda t: t != ""), lambda t: F.concat(F.lit("\n\n[Tabla]\n"), t, F.lit("\n")))
    whole = T.strip(F.concat(F.col("_x.text"), F.array_join(marked, "")))
    return own.withColumn("extracted", _extracted(whole, F.col("_x.tables"), error=F.col("_x.error"))).drop("_x")


def extract_text(files: DataFrame) -> DataFrame:
    return files.withColumn("extracted", _extracted(T.decoded(F.col("content"))))


def extract_html(files: DataFrame) -> DataFrame:
    own = files.withColumn("_x", html.parsed(T.decoded(F.col("content"))))
    return own.withColumn("extracted", _extracted(F.col("_x.text"), F.col("_x.tables"), error=F.col("_x.error"))).drop("_x")


def unread(files: DataFrame, reason: str = "no reader") -> DataFrame:
    """files with an `extracted` without text, for those that no way of extraction takes."""
    return files.withColumn("extracted", _extracted(F.lit(""), pages=F.lit(0), confidence=F.lit(0.0), error=F.lit(reason)))


def without_pages(files: DataFrame) -> DataFrame:
    """files (extracted, null where a parsed file has no page) with an error in its place."""
    none = _extracted(F.lit(""), pages=F.lit(0), confidence=F.lit(0.0), error=F.lit("no page could be read"))
    return files.withColumn("extracted", F.coalesce("extracted", none))


# Marks of pages that may hold tables.
TABLE_SIGNS = ("|", "\t", "CH ", "COEF", "CUOTA", "Tabla", "CHALET")


def pages_text(pages: DataFrame, *keys: str) -> DataFrame:
    """keys, extracted from (keys, page_no, text, tables) of a parsed pdf: tables follow a page's text, numbered per page."""
    sign = F.lit(False)
    for s in TABLE_SIGNS:
        sign = sign | F.contains(F.coalesce("text", F.lit("")), F.lit(s))
    tables = F.filter(F.transform(F.coalesce("tables", F.array().cast(TABLES)), T.format_table), lambda t: t != "")
    marked = F.transform(tables, lambda t, i: F.concat(F.lit("\n\n[Tabla "), (i + 1).cast("string"), F.lit("]\n"), t, F.lit("\n")))
    own = F.concat(F.coalesce("text", F.lit("")), F.when(sign, F.array_join(marked, "")).otherwise(""))
    kept = F.when(sign, F.col("tables")).otherwise(F.array().cast(TABLES))
    ordered = F.array_sort(F.collect_list(F.struct("page_no", own.alias("own"), kept.alias("tables"))))
    grouped = pages.groupBy(*keys).agg(ordered.alias("_p"))
    whole = T.strip(F.array_join(F.transform(F.filter("_p", lambda p: p["own"] != ""), lambda p: p["own"]), "\n"))
    all_tables = F.flatten(F.transform("_p", lambda p: F.coalesce(p["tables"], F.array().cast(TABLES))))
    return grouped.select(*keys, _extracted(whole, all_tables, F.size("_p"), F.when(whole != "", 1.0).otherwise(0.0)).alias("extracted"))


def _pages(read: Callable, *args) -> list[dict]:
    """A provider's pages of one file; a page that failed is left out."""
    return [{"page_no": n, "text": p[0] if isinstance(p, tuple) else p, "tables": p[1] if isinstance(p, tuple) else []} for n, p in enumerate(read(*args), 1) if p is not None]


def pdf_pages(files: DataFrame, *keys: str, name: str = "default") -> DataFrame:
    """keys, page_no, text, tables by the registered pdf provider; a file that it fails on has no pages."""
    read = provider("pdf", name)

    @F.pandas_udf(f"array<struct<page_no:int,text:string,tables:{TABLES}>>")
    def pages(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for contents in batches:
            out = []
            for content in contents:
                try:
                    out.append(_pages(read, content))
                except Exception:  # noqa: BLE001  one file must not stop the others
                    out.append([])
            yield pd.Series(out)

    return files.select(*keys, F.explode(pages("content")).alias("_p")).select(*keys, "_p.*")


#: How sure a text is that a cloud or a local engine has read.
CLOUD_CONFIDENCE, LOCAL_CONFIDENCE = 0.95, 0.85


def extract_ocr(files: DataFrame, local: Callable | None, cloud: Callable | None = None, by_cloud: Column | None = None) -> DataFrame:
    """files (content, file_type, ...) with `extracted` by readers of (bytes, type): pages under their marks, images as they are.

    Where by_cloud holds, the cloud's reader comes first and the local one takes what it fails on. A file that none can read
    has no text and the last error.
    """

    @F.pandas_udf("pages array<struct<page_no:int,text:string>>, confidence double, error string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for contents, types, clouds in batches:
            rows = []
            for content, kind, first in zip(contents, types, clouds, strict=True):
                ways = [(cloud, CLOUD_CONFIDENCE)] * bool(first and cloud) + [(local, LOCAL_CONFIDENCE)] * bool(local)
                row = ([], 0.0, "no reader")
                for way, confidence in ways:
                    try:
                        row = ([{"page_no": p["page_no"], "text": p["text"]} for p in _pages(way, content, kind)], confidence, None)
                        break
                    except Exception as e:  # noqa: BLE001  another way, or the other files
                        row = ([], 0.0, _named(e))
                rows.append(row)
            yield pd.DataFrame({"pages": [r[0] for r in rows], "confidence": [r[1] for r in rows], "error": pd.Series([r[2] for r in rows], dtype=object)})

    own = files.withColumn("_p", read("content", "file_type", F.lit(False) if by_cloud is None else by_cloud))
    marked = F.transform("_p.pages", lambda p: F.concat(F.lit("[Página "), p["page_no"].cast("string"), F.lit("]\n"), p["text"], F.lit("\n")))
    text = F.when(F.col("file_type") == "pdf", F.array_join(marked, "\n\n")).otherwise(F.array_join(F.transform("_p.pages", lambda p: p["text"]), "\n\n"))
    return own.withColumn("extracted", _extracted(T.strip(text), None, F.size("_p.pages"), F.col("_p.confidence"), F.col("_p.error"))).drop("_p")
