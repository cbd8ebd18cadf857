"""Captions of images put into texts, in the document's own row.

Each page's captions go to one place. The places that claim a page are, in order of lines and within a line in this
order: a line that names a section claims the pages of all lines that name that section, then its own page, the next and
the one before; any line claims its own page, and there captions are put in only if no section is named on that page
(otherwise they are left out). The first claim counts; pages that no line claims go to the end.

Only lines with a mark, and the first line, can be the first to claim a page, so claims are made from these alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkflow.functions import text as T

_LAST = (1 << 31) - 1


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: lambdas have no common subexpressions."""
    return F.transform(F.array(value), use)[0]


def _folded(items: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What each step adds: step(state, item) gives the next state and an element of type `kind`."""
    start = F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("done"))

    def next_(a: Column, x: Column) -> Column:
        after, added = step(a["state"], x)
        return F.struct(after.alias("state"), F.array_append(a["done"], added).alias("done"))

    return F.aggregate(items, start, next_, lambda a: a["done"])


def _claim(page: Column, line: Column, kind: int, rank: Column, section: Column) -> Column:
    return F.struct(page.alias("page"), line.alias("line"), F.lit(kind).alias("kind"), rank.cast("long").alias("rank"), section.alias("section"))


def _paged(lines: Column) -> Column:
    """(line, page, section) of the first line and of those with marks; pages carry on from the mark before, from 1."""
    marks = F.transform(lines, lambda x, i: F.struct(i.alias("line"), T.page_mark(x).alias("mark"), T.section_mark(x).alias("section")))
    own = F.filter(marks, lambda m: (m["line"] == 0) | m["mark"].isNotNull() | m["section"].isNotNull())

    def step(page: Column, m: Column) -> tuple[Column, Column]:
        here = F.coalesce(m["mark"], page)
        return here, F.struct(m["line"].alias("line"), here.alias("page"), m["section"].alias("section"))

    return _folded(own, F.lit(1).cast("long"), "struct<line:int,page:bigint,section:string>", step)


def _section_claims(named: Column) -> Column:
    """The first line of each section claims the pages of all its lines."""
    by_section = F.sort_array(F.transform(named, lambda m: F.struct(m["section"].alias("section"), m["line"].alias("line"), m["page"].alias("page"))))
    state = F.struct(F.lit("").alias("section"), F.lit(0).alias("first"))

    def step(a: Column, m: Column) -> tuple[Column, Column]:
        first = F.when(a["section"] == m["section"], a["first"]).otherwise(m["line"])
        return F.struct(m["section"].alias("section"), first.alias("first")), _claim(m["page"], first, 0, m["line"], m["section"])

    return _folded(by_section, state, "struct<page:bigint,line:int,kind:int,rank:bigint,section:string>", step)


def _first_claims(paged: Column, wanted: Column) -> Column:
    """The first claim on each wanted page."""

    def claims(named: Column) -> Column:
        near = F.flatten(F.transform(named, lambda m: F.array(*(_claim(m["page"] + d, m["line"], 1, F.lit(r), m["section"]) for r, d in enumerate((0, 1, -1))))))
        own = F.transform(paged, lambda m: _claim(m["page"], m["line"], 2, F.lit(0), F.lit(None).cast("string")))
        return F.sort_array(F.filter(F.concat(_section_claims(named), near, own), lambda c: F.array_contains(wanted, c["page"])))

    def first(found: Column) -> Column:
        return F.filter(found, lambda c, i: (i == 0) | (c["page"] != F.get(found, i - 1)["page"]))

    return _bound(_bound(F.filter(paged, lambda m: m["section"].isNotNull()), claims), first)


def _placed(captions: Column, claims: Column, sectioned: Column) -> Column:
    """(line, kind, rank, ordinal, content) of the captions that go into the text."""

    def place(c: Column, claim: Column) -> Column:
        first = F.array_min(F.transform(F.filter(captions, lambda d: d["page"] == c["page"]), lambda d: d["ordinal"]))
        page = c["page"].cast("string")
        visual = F.concat(F.lit("[Contenido visual de la página "), page, F.lit("]: "), c["caption"])
        inside = F.concat(F.lit("[Contenido de la página "), page, F.lit(" - PUNTO "), claim["section"], F.lit("]: "), c["caption"])
        return F.struct(
            F.coalesce(claim["line"], F.lit(_LAST)).alias("line"), F.coalesce(claim["kind"] + 1, F.lit(9)).alias("kind"), F.coalesce(claim["rank"], first).alias("rank"), c["ordinal"].alias("ordinal"),
            F.concat(F.lit("\n"), F.when(claim["kind"] < 2, inside).otherwise(visual), F.lit("\n")).alias("content"),
        )

    kept = F.filter(captions, lambda c: ~(F.array_contains(sectioned, c["page"]) & F.exists(claims, lambda f: (f["page"] == c["page"]) & (f["kind"] == 2))))
    return F.transform(kept, lambda c: _bound(F.get(F.filter(claims, lambda f: f["page"] == c["page"]), F.lit(0)), lambda claim: place(c, claim)))


def with_captions(text: Column, captions: Column) -> Column:
    """A text with captions (array of ordinal, page, caption; all bigint but the caption) at their places."""

    def woven(lines: Column, placed: Column) -> Column:
        own = F.transform(lines, lambda x, i: F.struct(i.alias("line"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("ordinal"), x.alias("content")))
        return F.array_join(F.transform(F.sort_array(F.concat(own, placed)), lambda x: x["content"]), "\n")

    def placed(paged: Column) -> Column:
        sectioned = F.array_distinct(F.transform(F.filter(paged, lambda m: m["section"].isNotNull()), lambda m: m["page"]))
        wanted = F.array_distinct(F.transform(captions, lambda c: c["page"]))
        claims = _bound(wanted, lambda w: _first_claims(paged, w))
        return _bound(F.struct(claims.alias("claims"), sectioned.alias("sectioned")), lambda b: _placed(captions, b["claims"], b["sectioned"]))

    return _bound(T.lines(F.coalesce(text, F.lit(""))), lambda lines: _bound(_bound(_paged(lines), placed), lambda own: woven(lines, own)))


def gathered(captions: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and `_captions`, the captions (key, ordinal, page, caption) of each document; a null page is page 1."""
    one = F.struct(F.col("ordinal").cast("long").alias("ordinal"), F.coalesce("page", F.lit(1)).cast("long").alias("page"), "caption")
    return captions.groupBy(key).agg(F.collect_list(one).alias("_captions"))


def injected(docs: DataFrame, captions: DataFrame, key: str = "doc_id", text: str = "text", wanted: Column | None = None, count: str | None = None) -> DataFrame:
    """docs with captions (key, ordinal, page, caption) in their text, where `wanted` holds; count: a column for their number.

    Captions are gathered by document and joined once; documents without any keep their text as it is, null included.
    """
    own = docs.join(gathered(captions, key), key, "left")
    if wanted is not None:
        own = own.withColumn("_captions", F.when(wanted, F.col("_captions")))
    whole = F.when(F.col("_captions").isNull(), F.col(text)).otherwise(with_captions(F.col(text), F.col("_captions")))
    number = [F.when(F.col("_captions").isNull(), 0).otherwise(F.size("_captions")).alias(count)] if count else []
    return own.select(*(whole.alias(text) if c == text else c for c in docs.columns), *number)


def caption_pages(captions: DataFrame, *keys: str, page: str = "page") -> DataFrame:
    """The distinct pages that have captions, ascending, and the number of captions of each group."""
    return captions.groupBy(*keys).agg(F.array_sort(F.collect_set(page)).alias("pages"), F.count(F.lit(1)).alias("n"))
