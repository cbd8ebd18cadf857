"""Chunking operators. Folds over a document's parts are `aggregate` expressions on the row that holds them.

A fold's state is the open chunk and the finished chunks, so it is linear in the document and stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkflow.config import DEFAULTS
from inkflow.functions import text as T
from inkflow.functions import tokens as K
from inkflow.functions import vocabulary as V
from inkflow.operators.structure import sectioned

_TEXTS = "array<string>"


def _empty(kind: str = _TEXTS) -> Column:
    return F.array().cast(kind)


def _no_text() -> Column:
    return F.lit(None).cast("string")


def fixed_windows(docs: DataFrame, *keys: str, size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """keys, chunk_index, content: windows of `size` tokens; words, or those of a vocabulary file."""
    own = F.coalesce(F.col(text), F.lit(""))
    if vocabulary is None:
        return docs.select(*keys, F.posexplode(K.windows(own, size, overlap)).alias("chunk_index", "content"))
    cut = docs.select(*keys, own.alias("_text"), V.ends(own, vocabulary).alias("_ends"))
    return cut.select(*keys, F.posexplode(V.windows(F.col("_text"), F.col("_ends"), size, overlap)).alias("chunk_index", "content"))


def _pack(parts: Column, sep: str, most: int, overlap: int, too_large: Callable[[Column], Column]) -> Column:
    """Chunks of parts joined by `sep` while their tokens add up to `most`.

    A part over `most` closes the open chunk and becomes the pieces of too_large(part). A chunk that is closed for lack of
    room passes its last `overlap` tokens on to the next.
    """
    # values that are used more than once are bound by a transform of one element, for lambdas have no common subexpressions
    counted = F.transform(parts, lambda p: F.struct(p.alias("text"), K.count(p).alias("n")))
    sized = F.transform(counted, lambda c: F.struct(c["text"].alias("text"), c["n"].alias("n"), F.when(c["n"] > most, too_large(c["text"])).otherwise(_empty()).alias("pieces")))

    def closed(a: Column) -> Column:
        return F.when(a["open"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["open"]))

    def state(text: Column, n: Column, done: Column) -> Column:
        return F.struct(text.alias("open"), n.alias("n"), done.alias("done"))

    def step(a: Column, p: Column) -> Column:
        def begun(tail: Column) -> Column:
            return F.when(tail == "", p["text"]).otherwise(F.concat(tail, F.lit(sep), p["text"]))

        if overlap:
            texts = F.transform(F.transform(F.array(K.last(a["open"], overlap)), begun), lambda t: state(t, K.count(t), closed(a)))
            next_chunk = texts[0]
        else:
            next_chunk = state(p["text"], p["n"], closed(a))
        added = F.when(a["open"].isNull(), p["text"]).otherwise(F.concat(a["open"], F.lit(sep), p["text"]))
        split = state(_no_text(), F.lit(0), F.concat(closed(a), p["pieces"]))
        full = a["open"].isNotNull() & (a["n"] + p["n"] > most)
        return F.when(p["n"] > most, split).when(full, next_chunk).otherwise(state(added, a["n"] + p["n"], a["done"]))

    return F.aggregate(sized, F.struct(_no_text().alias("open"), F.lit(0).alias("n"), _empty().alias("done")), step, closed)


def _full_parts(parts: Column) -> Column:
    return F.filter(F.transform(parts, T.strip), lambda p: p != "")


def _or_whole(chunks: Column, text: Column) -> Column:
    return F.transform(F.array(chunks), lambda c: F.when(F.size(c) == 0, F.array(text)).otherwise(c))[0]


def sentence_chunks(text: Column, most: int = DEFAULTS.chunk_max_tokens, overlap: int = DEFAULTS.chunk_overlap) -> Column:
    """Chunks of sentences; a sentence over `most` tokens becomes windows of tokens."""
    return _or_whole(_pack(_full_parts(F.split(text, r"(?U)(?<=[.!?])\s+")), " ", most, overlap, lambda s: K.windows(s, most, overlap)), text)


def _blocks(text: Column) -> Column:
    """A text's parts where it has marked tables: each table from its mark to a blank line after three lines, and the rest.

    A mark inside a table opens another one, and the earlier table is kept as a part.
    """
    own = T.lines(text)
    state = F.struct(F.lit("").alias("open"), F.lit(0).alias("lines"), F.lit(False).alias("table"), _empty().alias("done"))

    def closed(a: Column) -> Column:
        return F.when(a["lines"] == 0, a["done"]).otherwise(F.array_append(a["done"], a["open"]))

    def step(a: Column, x: Column) -> Column:
        mark = x.rlike(T.TABLE_MARK)
        joined = F.when(a["lines"] == 0, x).otherwise(F.concat_ws("\n", a["open"], x))
        ends = a["table"] & ~mark & (T.strip(x) == "") & (a["lines"] + 1 > 3)
        return F.struct(
            F.when(mark, x).when(ends, F.lit("")).otherwise(joined).alias("open"),
            F.when(mark, F.lit(1)).when(ends, F.lit(0)).otherwise(a["lines"] + 1).alias("lines"),
            (mark | (a["table"] & ~ends)).alias("table"),
            F.when(mark, closed(a)).when(ends, F.array_append(a["done"], joined)).otherwise(a["done"]).alias("done"),
        )

    return F.aggregate(own, state, step, closed)


def paragraph_chunks(text: Column, most: int = DEFAULTS.chunk_max_tokens, overlap: int = DEFAULTS.chunk_overlap) -> Column:
    """Chunks of paragraphs, or of marked tables and what lies between them; blank texts have none."""
    marked = text.rlike(r"(?imU)^\[Tabla\s+\d+\]")
    parts = F.when(marked, _blocks(text)).otherwise(F.split(text, r"(?U)\n\s*\n"))
    chunks = _or_whole(_pack(_full_parts(parts), "\n\n", most, overlap, lambda p: sentence_chunks(p, most, overlap)), text)
    return F.when(T.strip(text) == "", _empty()).otherwise(chunks)


def embedding_pieces(text: Column, most: int = DEFAULTS.embedding_max_tokens) -> Column:
    """A text in pieces of at most `most` tokens: sentences (cut at `. `) are packed; every piece but the last ends with a
    full stop; a piece that is still over `most` is packed by paragraphs, and a single paragraph stays whole."""

    def packed(parts: Column, sep: str, end: str) -> Column:
        sized = F.transform(parts, lambda p: F.struct(p.alias("text"), K.count(p).alias("n")))

        def step(a: Column, p: Column) -> Column:
            full = a["open"].isNotNull() & (a["n"] + p["n"] > most)
            return F.struct(
                F.when(full | a["open"].isNull(), p["text"]).otherwise(F.concat(a["open"], F.lit(sep), p["text"])).alias("open"),
                F.when(full, p["n"]).otherwise(a["n"] + p["n"]).alias("n"),
                F.when(full, F.array_append(a["done"], F.concat(a["open"], F.lit(end)))).otherwise(a["done"]).alias("done"),
            )

        return F.aggregate(sized, F.struct(_no_text().alias("open"), F.lit(0).alias("n"), _empty().alias("done")), step, lambda a: F.array_append(a["done"], a["open"]))

    def again(piece: Column) -> Column:
        return F.when(K.count(piece) <= most, F.array(piece)).otherwise(packed(F.split(piece, r"\n\n"), "\n\n", ""))

    return F.when(K.count(text) <= most, F.array(text)).otherwise(F.flatten(F.transform(packed(F.split(text, r"\. "), ". ", "."), again)))


_SECTION = "type:string,content:string,heading:string"
_CHUNK = "array<struct<content:string,section:string,sections:int,has_table:boolean,has_heading:boolean>>"


def section_chunks(parts: Column, most: int = DEFAULTS.chunk_max_tokens, overlap: int = DEFAULTS.chunk_overlap, tables: bool = True) -> Column:
    """Chunks of ordered sections (type, content, heading): array of (content, section, sections, has_table, has_heading).

    Sections are never split. A table that does not fit opens a chunk of its own start; any other section that does not
    fit follows the last section of the chunk before, whole if it is within the overlap and by its last tokens if not.
    """
    sized = F.transform(parts, lambda s: F.struct(s["type"].alias("type"), s["content"].alias("content"), s["heading"].alias("heading"), K.count(s["content"]).alias("n")))
    none = F.struct(_no_text().alias("type"), _no_text().alias("content"), _no_text().alias("heading"))
    state = F.struct(
        F.lit(0).alias("sections"), F.lit(0).alias("n"), F.lit("").alias("content"), F.lit("").alias("section"), F.lit(False).alias("has_table"), F.lit(False).alias("has_heading"), none.alias("last"), _empty(_CHUNK).alias("done")
    )

    def chunk(a: Column) -> Column:
        return F.struct(*(a[k].alias(k) for k in ("content", "section", "sections", "has_table", "has_heading")))

    def finished(a: Column) -> Column:
        return F.when(a["sections"] == 0, a["done"]).otherwise(F.array_append(a["done"], chunk(a)))

    def step(a: Column, s: Column) -> Column:
        full = (a["sections"] > 0) & (a["n"] + s["n"] > most)
        apart = full & ((s["type"] == "table") if tables else F.lit(False))
        whole = K.count(a["last"]["content"]) <= overlap
        tail = F.struct(
            F.when(whole, a["last"]["type"]).otherwise("text").alias("type"),
            F.when(whole, a["last"]["content"]).otherwise(K.last(a["last"]["content"], overlap)).alias("content"),
            F.when(whole, a["last"]["heading"]).otherwise("").alias("heading"),
        )

        def choose(alone: Column, after: Column, added: Column) -> Column:
            return F.when(apart | (a["sections"] == 0), alone).when(full, after).otherwise(added)

        after = F.concat(tail["content"], F.lit("\n\n"), s["content"])
        return F.struct(
            choose(F.lit(1), F.lit(2), a["sections"] + 1).alias("sections"),
            choose(s["n"], K.count(after), a["n"] + s["n"]).alias("n"),
            choose(s["content"], after, F.concat(a["content"], F.lit("\n\n"), s["content"])).alias("content"),
            choose(s["heading"], F.when(tail["heading"] != "", tail["heading"]).otherwise(s["heading"]), F.when(a["section"] != "", a["section"]).otherwise(s["heading"])).alias("section"),
            choose(s["type"] == "table", (tail["type"] == "table") | (s["type"] == "table"), a["has_table"] | (s["type"] == "table")).alias("has_table"),
            choose(s["type"] == "heading", (tail["type"] == "heading") | (s["type"] == "heading"), a["has_heading"] | (s["type"] == "heading")).alias("has_heading"),
            F.struct(s["type"].alias("type"), s["content"].alias("content"), s["heading"].alias("heading")).alias("last"),
            F.when(full, finished(a)).otherwise(a["done"]).alias("done"),
        )

    return F.aggregate(sized, state, step, finished)


def semantic_chunks(docs: DataFrame, *keys: str, most: int = DEFAULTS.chunk_max_tokens, overlap: int = DEFAULTS.chunk_overlap, tables: bool = True) -> DataFrame:
    """keys, chunk_index, content, tokens, section, sections, has_table, has_heading: a document's chunks by sections."""
    # every document has a chunk; without `outer` a filter on their number would be pushed down, where it folds them all again
    chunks = sectioned(docs, *keys).select(*keys, F.posexplode_outer(section_chunks(F.col("_parts"), most, overlap, tables)).alias("chunk_index", "_c"))
    return chunks.select(*keys, "chunk_index", "_c.content", K.count(F.col("_c.content")).alias("tokens"), "_c.section", "_c.sections", "_c.has_table", "_c.has_heading")


def split_for_embedding(chunks: DataFrame, *keys: str, most: int = DEFAULTS.embedding_max_tokens) -> DataFrame:
    """chunks with those over `most` tokens split: content and tokens of the piece, chunk_index, is_split,
    original_chunk_index, split_index. A split chunk's index is 1000 times the old one plus the piece's place, which is
    not unique; it orders pieces and is no key."""
    pieces = chunks.withColumn("_p", embedding_pieces(F.col("content"), most))
    flat = pieces.select(*(c for c in chunks.columns if c not in ("content", "tokens", "chunk_index")), F.col("chunk_index").alias("original_chunk_index"), F.size("_p").alias("_n"), F.posexplode("_p").alias("split_index", "content"))
    is_split = F.col("_n") > 1
    return flat.select(
        "*", K.count(F.col("content")).alias("tokens"), is_split.alias("is_split"), F.when(is_split, F.col("original_chunk_index") * 1000 + F.col("split_index")).otherwise(F.col("original_chunk_index")).alias("chunk_index")
    ).drop("_n")


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """One row: n_chunks, mean_tokens, with_table, with_heading."""
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("tokens").alias("mean_tokens"), F.count_if("has_table").alias("with_table"), F.count_if("has_heading").alias("with_heading"))


def split_positions(rows: DataFrame, group: str, ordinal: str) -> DataFrame:
    """rows with n_splits and split_index of rows that share `group`, in the order of `ordinal`."""
    own = Window.partitionBy(group)
    return rows.withColumn("n_splits", F.count(F.lit(1)).over(own)).withColumn("split_index", F.row_number().over(own.orderBy(ordinal)) - 1)
