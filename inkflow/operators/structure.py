"""The structure of texts: headings, sections, tables and lists as runs of lines.

Every operator takes rows (key columns, text) and finds the runs in the row itself, by arrays of flags of its lines, so nothing
is shuffled and a document's size is the only bound; keys need not be unique.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkflow.functions import text as T


def line_rows(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys, line (from 0), content, n_lines."""
    own = T.lines(F.coalesce(F.col(text), F.lit("")))
    return docs.select(*keys, F.size(own).alias("n_lines"), F.posexplode(own).alias("line", "content"))


def _lined(docs: DataFrame, keys: tuple[str, ...], **flags: Callable[[Column], Column]) -> DataFrame:
    """keys, _lines, and an array for each flag. Each is a projection of its own, so that lambdas read them and compute none anew."""
    own = docs.select(*keys, T.lines(F.coalesce(F.col("text"), F.lit(""))).alias("_lines"))
    return own.select("*", *(F.transform("_lines", f).alias(name) for name, f in flags.items()))


def _places(of: str | Column, keep: Callable[[Column], Column]) -> Column:
    """The indexes of an array that satisfy a condition."""
    return F.filter(F.sequence(F.lit(0), F.size(of) - 1), keep)


def _runs(rows: DataFrame, keys: tuple[str, ...], flag: str, *more: str) -> DataFrame:
    """keys, start, end and more of each run of lines that have the flag."""
    here = F.col(flag)
    starts = _places(flag, lambda i: here[i] & ((i == 0) | ~F.coalesce(F.get(here, i - 1), F.lit(False))))
    ends = _places(flag, lambda i: here[i] & ~F.coalesce(F.get(here, i + 1), F.lit(False)))
    return rows.select(*keys, *more, F.explode(F.arrays_zip(starts.alias("start"), ends.alias("end"))).alias("_r")).select(*keys, *more, "_r.start", "_r.end")


def headings(docs: DataFrame, *keys: str) -> DataFrame:
    """keys, line, level, heading: lines that are headings once stripped."""
    own = T.strip(F.col("content"))
    return line_rows(docs, *keys).filter(T.is_heading(own)).select(*keys, "line", T.heading_level(own).alias("level"), T.heading_text(own).alias("heading"))


def section_ranges(docs: DataFrame, *keys: str) -> DataFrame:
    """keys, start, end, level: from each heading to the next; level 1 for what comes before the first."""
    rows = _lined(docs, keys, _levels=lambda x: F.when(T.is_heading(T.strip(x)), T.heading_level(T.strip(x))))
    levels, starts = F.col("_levels"), F.col("_starts")
    cut = rows.select(*keys, "_levels", _places("_levels", lambda i: (i == 0) | levels[i].isNotNull()).alias("_starts"))
    ranged = F.transform(starts, lambda s, k: F.struct(s.alias("start"), (F.coalesce(F.get(starts, k + 1), F.size(levels)) - 1).alias("end"), F.coalesce(levels[s], F.lit(1)).alias("level")))
    return cut.select(*keys, F.explode(ranged).alias("_r")).select(*keys, "_r.*")


def table_runs(docs: DataFrame, *keys: str, last_line: bool = False) -> DataFrame:
    """keys, start, end, rows of runs of table lines; a run that touches the last line counts only if last_line."""
    rows = _lined(docs, keys, _flag=T.is_table_line).withColumn("_n", F.size("_lines"))
    out = _runs(rows, keys, "_flag", "_n")
    kept = out if last_line else out.filter("end < _n - 1")
    return kept.select(*keys, "start", "end", (F.col("end") - F.col("start") + 1).alias("rows"))


def list_runs(docs: DataFrame, *keys: str) -> DataFrame:
    """keys, start, end, type of runs of list items; the first item gives the type."""
    rows = _lined(docs, keys, _flag=T.is_list_item)
    first = T.strip(F.get("_lines", F.col("start")))
    kind = F.when(first.rlike(r"^[*\-+]"), "unordered").otherwise("ordered")
    return _runs(rows, keys, "_flag", "_lines").select(*keys, "start", "end", kind.alias("type"))


def structure(docs: DataFrame, *keys: str) -> DataFrame:
    """One row for each document: keys, text, n_lines, n_headings, n_tables, n_lists, quality_score.

    Counts come from the row's own lines, so nothing is shuffled.
    """
    rows = _lined(docs, (*keys, "text"), _head=lambda x: T.is_heading(T.strip(x)), _bar=T.is_table_line, _item=T.is_list_item)
    bar, item = F.col("_bar"), F.col("_item")
    n_tables = F.size(_places("_bar", lambda i: bar[i] & ~F.coalesce(F.get(bar, i + 1), F.lit(True))))
    n_lists = F.size(_places("_item", lambda i: item[i] & ((i == 0) | ~F.coalesce(F.get(item, i - 1), F.lit(False)))))
    counted = rows.select(*keys, "text", F.size("_lines").alias("n_lines"), F.size(F.filter("_head", lambda x: x)).alias("n_headings"), n_tables.alias("n_tables"), n_lists.alias("n_lists"))
    return counted.withColumn("quality_score", T.quality_score(F.coalesce("text", F.lit("")), F.col("n_headings"), F.col("n_tables")))


def sections(docs: DataFrame, *keys: str) -> DataFrame:
    """keys, ordinal, type (text, heading or table), level, heading, content: the chunker's sections, a row each."""
    cut = sectioned(docs, *keys)
    # every document has a section; without `outer` a filter on their number would be pushed down, where it finds them all again
    return cut.select(*keys, F.posexplode_outer("_parts").alias("ordinal", "_p")).select(*keys, "ordinal", "_p.type", "_p.level", "_p.heading", "_p.content")


def sectioned(docs: DataFrame, *keys: str) -> DataFrame:
    """keys and _parts, the sections (type, level, heading, content) of each document in order.

    A heading line opens a section; after the first table line of a section all that follows is a table up to the next
    heading. Heading lines are not stripped here.
    """
    rows = _lined(docs, keys, _head=T.is_heading, _bar=T.is_table_line)
    head, starts, lines = F.col("_head"), F.col("_starts"), F.col("_lines")
    flagged = rows.select(*keys, "_lines", "_head", F.zip_with("_bar", "_head", lambda b, h: b & ~h).alias("_bar"), _places("_head", lambda i: (i == 0) | head[i]).alias("_starts"))
    bars = F.col("_bar")
    spans = F.transform(starts, lambda s, k: F.struct(s.alias("s"), (F.coalesce(F.get(starts, k + 1), F.size(lines)) - 1).alias("e")))
    cut = flagged.select(*keys, "_lines", "_head", "_bar", spans.alias("_spans"))
    # where a section's table begins, or one past its end
    split = F.transform("_spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.coalesce(F.get(F.filter(F.sequence(x["s"], x["e"]), lambda i: bars[i]), 0), x["e"] + 1).alias("t")))
    cut = cut.select(*keys, "_lines", "_head", split.alias("_spans"))

    def part(table: bool, a: Column, b: Column) -> Column:
        opens = F.lit(False) if table else head[a]
        return F.struct(
            F.lit("table").alias("type") if table else F.when(opens, "heading").otherwise("text").alias("type"), F.when(opens, T.heading_level(lines[a])).otherwise(0).alias("level"),
            F.when(opens, T.heading_text(lines[a])).otherwise("").alias("heading"), F.array_join(F.slice(lines, a + 1, b - a), "\n").alias("content"), (b > a).alias("any"),
        )

    both = F.flatten(F.transform("_spans", lambda x: F.array(part(False, x["s"], x["t"]), part(True, x["t"], x["e"] + 1))))
    return cut.select(*keys, F.filter(both, lambda p: p["any"]).alias("_parts"))
