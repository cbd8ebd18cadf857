"""Which images of a document are worth a caption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkflow.config import DEFAULTS


def is_decorative(width: Column, height: Column) -> Column:
    ratio = F.when(height > 0, width / F.nullif(height, F.lit(0))).otherwise(1.0)
    return (width < 200) | (height < 200) | ((ratio > 0.9) & (ratio < 1.1) & (width < 300))


def is_relevant(kind: Column, width: Column, height: Column) -> Column:
    w, h = F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0))
    return (kind == "full_page") | ((w >= 100) & (h >= 100) & ~is_decorative(w, h))


def chosen_images(images: DataFrame, *keys: str, most: int = DEFAULTS.max_images) -> DataFrame:
    """The relevant images in the order of work (`rank`): all full pages, then others up to `most` in all."""
    full = F.col("type") == "full_page"
    order = Window.partitionBy(*keys).orderBy(full.desc(), "ordinal")
    ranked = images.filter(is_relevant(F.col("type"), F.col("width"), F.col("height"))).withColumn("rank", F.row_number().over(order))
    return ranked.filter(full | (F.col("rank") <= most))
