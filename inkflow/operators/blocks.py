"""OCR block graphs as text and tables, by joins on block ids.

blocks: doc_id, ordinal, id, block_type (LINE, TABLE, CELL, WORD), page, row_index, column_index, text, child_ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkflow.functions import text as T


def block_text(blocks: DataFrame) -> DataFrame:
    """doc_id, text: the lines in order, with a page mark where the page changes (documents begin on page 1)."""
    order = Window.partitionBy("doc_id").orderBy("ordinal")
    lines = blocks.filter("block_type = 'LINE'")
    page = F.coalesce("page", F.last("page", True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1))
    marked = lines.withColumn("_page", page).withColumn("_before", F.lag("_page", 1, 1).over(order))
    piece = F.when(F.col("_page") != F.col("_before"), F.concat(F.lit("\n[Página "), F.col("_page").cast("string"), F.lit("]\n\n"), F.coalesce("text", F.lit("")))).otherwise(F.coalesce("text", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", piece.alias("piece"))))
    return marked.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "\n").alias("text"))


def table_cells(blocks: DataFrame) -> DataFrame:
    """doc_id, table_ordinal, row, column, text: of cells at one place the first counts; cells of no known id are left out."""
    tables = blocks.filter("block_type = 'TABLE'").select("doc_id", F.col("ordinal").alias("table_ordinal"), F.posexplode("child_ids").alias("place", "id"))
    cells = blocks.filter("block_type = 'CELL'").select("doc_id", "id", F.coalesce("row_index", F.lit(0)).alias("row"), F.coalesce("column_index", F.lit(0)).alias("column"), "child_ids")
    placed = tables.join(cells, ["doc_id", "id"])
    one = placed.groupBy("doc_id", "table_ordinal", "row", "column").agg(F.min_by("child_ids", "place").alias("child_ids"))
    words = blocks.filter("block_type = 'WORD'").select("doc_id", F.col("id").alias("word_id"), F.coalesce("text", F.lit("")).alias("word"))
    keys = ["doc_id", "table_ordinal", "row", "column"]
    named = one.select(*keys, F.posexplode_outer("child_ids").alias("at", "word_id")).join(words, ["doc_id", "word_id"], "left")
    ordered = F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("at", "word"))))
    return named.groupBy(*keys).agg(T.strip(F.array_join(F.transform(ordered, lambda x: x["word"]), " ")).alias("text"))


def block_tables(blocks: DataFrame) -> DataFrame:
    """doc_id, table_ordinal, rows (array of arrays): dense grids from row and column 1, with '' where there is no cell."""
    grid = table_cells(blocks).groupBy("doc_id", "table_ordinal").agg(
        F.max("row").alias("n_rows"), F.max("column").alias("n_columns"), F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", F.col("row").cast("string"), F.col("column").cast("string")), "text"))).alias("at")
    )

    def numbers(n):
        return F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))

    rows = F.transform(numbers(F.col("n_rows")), lambda r: F.transform(numbers(F.col("n_columns")), lambda c: F.coalesce(F.try_element_at(F.col("at"), F.concat_ws(":", r.cast("string"), c.cast("string"))), F.lit(""))))
    return grid.select("doc_id", "table_ordinal", rows.alias("rows")).filter(F.size("rows") > 0)


def extracted_blocks(blocks: DataFrame, confidence: float = 0.95) -> DataFrame:
    """doc_id, text, tables, pages_processed, confidence of each document."""
    pages = blocks.groupBy("doc_id").agg(F.count_distinct(F.coalesce("page", F.lit(1))).alias("pages_processed"))
    tables = block_tables(blocks).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("table_ordinal", "rows"))), lambda x: x["rows"]).alias("tables"))
    out = pages.join(block_text(blocks), "doc_id", "left").join(tables, "doc_id", "left")
    return out.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("tables", F.array().cast("array<array<array<string>>>")).alias("tables"), "pages_processed", F.lit(confidence).alias("confidence"))
