"""Routing: what a document's type, text coverage, length and layout say about how to extract it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkflow.config import DEFAULTS, Settings
from inkflow.functions import text as T

NATIVE, IMAGES = ("docx", "html", "txt"), ("png", "jpeg", "tiff")
PARSER, LOCAL_OCR, CLOUD_OCR, HYBRID = "local_parser", "local_ocr", "cloud_ocr", "hybrid"


def text_coverage(pages: DataFrame, *keys: str, sampled: int = 3, least: int = 50) -> DataFrame:
    """keys, page_count, coverage (share of the first pages with enough text), confidence, sample from (keys, page_no, text)."""
    first = F.col("page_no") <= sampled
    full = F.length(T.strip(F.coalesce("text", F.lit("")))) >= least
    sample = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(first, F.struct("page_no", "text")))), lambda x: x["text"]), "\n")
    grouped = pages.groupBy(*keys).agg(F.max("page_no").alias("page_count"), F.count_if(first).alias("_n"), F.count_if(first & full).alias("_full"), sample.alias("sample"))
    n = F.greatest("_n", F.lit(1))
    return grouped.select(*keys, "page_count", (F.col("_full") / n).alias("coverage"), F.least(F.lit(1.0), F.col("_n") / F.lit(float(sampled))).alias("confidence"), "sample")


def layout_class(file_type: Column, sample: Column) -> Column:
    """simple, moderate or complex; only pdf is looked at."""
    low = F.lower(sample)
    hits = sum((F.contains(low, F.lit(w)).cast("int") for w in T.LAYOUT_WORDS), F.lit(0))
    table = F.contains(sample, F.lit("|")) | F.contains(sample, F.lit("\t"))
    own = T.lines(sample)
    short = F.size(F.filter(own, lambda x: (F.length(T.strip(x)) > 0) & (F.length(T.strip(x)) < 30)))
    columns = short > F.size(own) * 0.3
    return F.when(file_type != "pdf", "simple").when((hits >= 2) | (table & columns), "complex").when((hits >= 1) | table, "moderate").otherwise("simple")


def sample_defaults(file_type: Column) -> tuple[Column, Column]:
    """Coverage and confidence of types that are not sampled."""
    coverage = F.when(file_type == "docx", 1.0).otherwise(0.0)
    confidence = F.when(file_type.isin("docx", *IMAGES), 1.0).otherwise(0.5)
    return coverage, confidence


def strategy(file_type: Column, coverage: Column, pages: Column, layout: Column, settings: Settings = DEFAULTS) -> Column:
    """The way of extraction."""
    parser, local, cloud, hybrid = map(F.lit, (PARSER, LOCAL_OCR, CLOUD_OCR, HYBRID))
    if not settings.ocr:
        return F.when(file_type.isNotNull(), parser).otherwise(parser)
    scarce, mixed = coverage < 0.1, coverage < settings.coverage_threshold
    out = F.when(file_type.isin(*NATIVE), parser)
    if settings.cloud_available:
        return out.when(layout.isin("complex", "moderate") | (pages >= 5), cloud).when(~mixed, parser).when(scarce, local).when(mixed, hybrid).otherwise(parser)
    return out.when(~mixed, parser).when((layout == "complex") | scarce, local).when(mixed, hybrid).otherwise(parser)


def route(files: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """files (file_type, coverage, page_count, sample) with layout, strategy, requires_ocr, requires_vision."""
    out = files.withColumn("layout", layout_class(F.col("file_type"), F.coalesce("sample", F.lit(""))))
    out = out.withColumn("strategy", strategy(F.col("file_type"), F.col("coverage"), F.col("page_count"), F.col("layout"), settings))
    return out.withColumn("requires_ocr", F.col("strategy").isin(LOCAL_OCR, CLOUD_OCR, HYBRID)).withColumn("requires_vision", F.col("file_type") == "pdf")


def captions_wanted(file_type: Column, strategy_: Column, settings: Settings = DEFAULTS) -> Column:
    """Whether images are captioned: not without OCR, and not where cloud OCR reads them."""
    if not (settings.ocr and settings.image_captions):
        return F.lit(False)
    return (file_type == "pdf") & ~((strategy_ == CLOUD_OCR) & F.lit(settings.cloud_ocr))
