"""Providers of OCR and captions: choice by configuration, retries, fall-backs, and captions as a column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StringType, StructField, StructType

from inkflow.functions import text as T
from inkflow.operators.routing import IMAGES
from inkflow.sources.files import provider

#: Bytes that a synchronous call of the aws provider takes.
SYNC_BYTES = 5000 * 1024
CLOUDS = ("aws", "azure")
CAPTION = StructType([StructField("text", StringType()), StructField("confidence", DoubleType())])


class Unsupported(Exception):
    """A document that one way of a provider cannot read and another may."""


def cloud_reader(name: str, credentials: bool = True) -> Callable[[bytes, str], list]:
    """The registered provider of a cloud; for aws, documents over the synchronous limit are refused."""
    if name.lower() not in CLOUDS:
        raise ValueError(f"no cloud named {name}")
    if not credentials:
        raise ValueError(f"{name} has no credentials")
    read = provider("ocr", name.lower())
    if name.lower() != "aws":
        return read

    def limited(content: bytes, kind: str) -> list:
        if len(content) > SYNC_BYTES:
            raise Unsupported(f"{len(content)} bytes are over the limit of a synchronous call")
        return read(content, kind)

    return limited


def first_of(*readers: Callable[[bytes, str], list]) -> Callable[[bytes, str], list]:
    """The first reader that does not refuse a document: text detection before table analysis, a cloud before local OCR."""

    def read(content: bytes, kind: str) -> list:
        for k, reader in enumerate(readers):
            try:
                return reader(content, kind)
            except Unsupported:
                if k == len(readers) - 1:
                    raise
        raise ValueError("no reader")

    return read


def paragraph_text(paragraphs: Column) -> Column:
    """The text of a layout service's answer: its paragraphs' contents, a line each."""
    return F.array_join(F.filter(paragraphs, lambda p: p.isNotNull() & (T.strip(p) != "")), "\n")


def images_of(files: DataFrame, *keys: str, name: str = "default") -> DataFrame:
    """keys, ordinal, image_id, page, type, width, height, content, base64 of each image in a document.

    The registered images provider takes (bytes, file type) and gives (page, type, width, height, bytes) for embedded images and
    rendered pages; a file that is an image is the single image img_0 without a size. A file that it fails on has no images.
    """
    read = provider("images", name)
    own = StructType([StructField(n, t) for n, t in (("page", IntegerType()), ("type", StringType()), ("width", IntegerType()), ("height", IntegerType()), ("content", BinaryType()))])

    def listed(content: bytes, kind: str) -> list[dict]:
        try:
            return [dict(zip(own.names, x, strict=True)) for x in (read(content, kind) if kind == "pdf" else [(1, "photo", None, None, content)])]
        except Exception:  # noqa: BLE001  one file must not stop the others
            return []

    @F.pandas_udf(ArrayType(own))
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for contents, kinds in batches:
            yield pd.Series(list(map(listed, contents, kinds)))

    rows = files.filter(F.col("file_type").isin("pdf", *IMAGES)).select(*keys, F.posexplode(found("content", "file_type")).alias("ordinal", "_i"))
    image_id = F.concat_ws("_", F.lit("img"), F.col("ordinal").cast("string"))
    return rows.select(*keys, "ordinal", image_id.alias("image_id"), "_i.*", F.base64("_i.content").alias("base64"))


# What stands for a caption that could not be made: of a rendered page without a model, of one that failed,
# and of any other image.
PAGE_WITHOUT_MODEL, PAGE_FAILED, IMAGE_WITHOUT_CAPTION = "[Page {} content]", "[Page {} content - extraction failed]", "[Image on page {}]"


def captioned(images: DataFrame, name: str | None = "default", confidence: float = 0.95) -> DataFrame:
    """images (content, page, type, ...) with `caption` and `confidence`.

    Without a model (name None), without content and where the model fails, a placeholder stands with confidence 0. A null
    page is "unknown".
    """
    model = provider("caption", name) if name else None

    def one(content, page: str, kind: str) -> tuple[str, float]:
        whole = kind == "full_page"
        if model is None:
            return (PAGE_WITHOUT_MODEL if whole else IMAGE_WITHOUT_CAPTION).format(page), 0.0
        try:
            if not content:
                raise ValueError("no image data")
            return model(content), confidence
        except Exception:  # noqa: BLE001  one image must not stop the others
            return (PAGE_FAILED if whole else IMAGE_WITHOUT_CAPTION).format(page), 0.0

    @F.pandas_udf(CAPTION)
    def captions(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            yield pd.DataFrame([one(*x) for x in zip(*columns, strict=True)], columns=["text", "confidence"])

    own = images.withColumn("_c", captions("content", F.coalesce(F.col("page").cast("string"), F.lit("unknown")), F.coalesce("type", F.lit(""))))
    return own.withColumn("caption", F.col("_c.text")).withColumn("confidence", F.col("_c.confidence")).drop("_c")
