"""Text functions as Column expressions: lines, markdown marks, tables, previews, rankings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File types by extension, and the words of layouts and of questions about points.
FILE_TYPES = {"pdf": "pdf", "docx": "docx", "doc": "docx", "html": "html", "htm": "html", "txt": "txt", "png": "png", "jpg": "jpeg", "jpeg": "jpeg", "tiff": "tiff", "tif": "tiff"}
LAYOUT_WORDS = ("form", "table", "multi-column", "handwriting", "signature")
POINT_WORDS = ("punto", "puntos", "sección", "apartado", "tema")
HEADING = r"(?U)^(#{1,6})\s+([^\n]+)$"
LIST_ITEM = r"(?U)^(?:[*\-+]|\d+\.)\s+"
PAGE_MARK = r"(?U)[Pp]ágina\s+(\d+)"
SECTION_MARK = r"(?iU)punto\s+(\d+(?:\.\d+)?)"
TABLE_MARK = r"(?iU)^\[Tabla\s+\d+\]"


def strip(x: Column) -> Column:
    """Without white space at both ends (Unicode's, not spaces only)."""
    return F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def pipes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))


def is_table_line(line: Column) -> Column:
    return pipes(line) >= 2


def is_heading(line: Column) -> Column:
    return line.rlike(HEADING)


def heading_level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, HEADING, 1))


def heading_text(line: Column) -> Column:
    return F.regexp_extract(line, HEADING, 2)


def is_list_item(line: Column) -> Column:
    return strip(line).rlike(LIST_ITEM)


def page_mark(line: Column) -> Column:
    """The page that a line names; null if none."""
    return F.regexp_extract(line, PAGE_MARK, 1).try_cast("long")


def section_mark(line: Column) -> Column:
    """The section that a line names; null if none."""
    return F.nullif(F.regexp_extract(line, SECTION_MARK, 1), F.lit(""))


def file_type(name: Column) -> Column:
    """The type by a name's last dot-separated part; `unknown` for others and for no name."""
    types = F.create_map(*(F.lit(x) for pair in FILE_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(types, F.lower(F.element_at(F.split(F.coalesce(name, F.lit("")), r"\."), -1))), F.lit("unknown"))


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8, else Latin-1."""
    utf8 = content.cast("string")
    return F.when(F.is_valid_utf8(utf8), utf8).otherwise(F.decode(content, "ISO-8859-1"))


def preview(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def clean_table_row(line: Column, strict: bool = False) -> Column:
    """A markdown row with one space around each cell.

    strict: the first and last parts are dropped even if the row has no outer pipes, so `a | b | c` gives `| b |`.
    """
    whole = line if strict else F.regexp_replace(strip(line), r"^\|?((?s:.*?))\|?$", "|$1|")
    cells = F.split(whole, r"\|")
    inner = F.transform(F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 2, F.lit(0))), strip)
    return F.concat(F.lit("| "), F.array_join(inner, " | "), F.lit(" |"))


def clean_tables(text: Column, strict: bool = False) -> Column:
    return F.array_join(F.transform(lines(text), lambda x: F.when(is_table_line(x), clean_table_row(x, strict)).otherwise(x)), "\n")


def format_table(rows: Column) -> Column:
    """Rows of cells as text: blank rows dropped, cells stripped, rows padded to the widest, ` | ` between cells."""
    plain = F.transform(F.coalesce(rows, F.array().cast("array<array<string>>")), lambda r: F.transform(F.coalesce(r, F.array().cast("array<string>")), lambda c: strip(F.coalesce(c, F.lit("")))))
    full = F.filter(plain, lambda r: F.exists(r, lambda c: c != ""))
    width = F.coalesce(F.array_max(F.transform(full, F.size)), F.lit(0))
    return F.array_join(F.transform(full, lambda r: F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | ")), "\n")


def parse_ranking(response: Column, n: Column) -> Column:
    """The order that a ranker's answer gives to n items: the numbers under n as they first come, then the rest."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(response, F.lit("")), F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("int"))
    valid = F.filter(numbers, lambda x: x.isNotNull() & (x < n))
    return F.when(n > 0, F.array_union(valid, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1))).otherwise(F.array().cast("array<int>"))


def about_points(question: Column) -> Column:
    low = F.lower(question)
    out = F.lit(False)
    for word in POINT_WORDS:
        out = out | F.contains(low, F.lit(word))
    return out


def expanded_question(question: Column) -> Column:
    return F.when(about_points(question), F.concat(question, F.lit(" PUNTO punto"))).otherwise(question)


def effective_k(question: Column, k: Column, default: int, least: int) -> Column:
    """k, or the default for null and 0; at least `least` for questions about points."""
    own = F.when(k.isNull() | (k == 0), F.lit(default)).otherwise(k)
    return F.when(about_points(question), F.greatest(own, F.lit(least))).otherwise(own)


def quality_score(markdown: Column, n_headings: Column, n_tables: Column) -> Column:
    """0 for blank text; otherwise 1, times 0.9 without headings, times 0.95 without tables or over ten pipes."""
    blank = F.when(strip(markdown) == "", 0.0).otherwise(1.0)
    return blank * F.when(n_headings > 0, 1.0).otherwise(0.9) * F.when((n_tables > 0) | (pipes(markdown) > 10), 1.0).otherwise(0.95)


def merged_metadata(*maps: Column) -> Column:
    """Maps of metadata in one; of equal keys the last counts."""
    entries = F.concat(*(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))) for m in maps))
    n = F.size(entries)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)
