"""Further queries over the driver's tables: sources, filters on JSON, records and routing flags, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkflow.config import Settings
from inkflow.functions import json_filter, lexical
from inkflow.functions import text as T
from inkflow.operators import catalog, chunking, routing
from inkflow.plans import ingest
from inkflow.plans.catalogue import _STRIPPED, _WORDS, query, table
from inkflow.sources import files, html, providers


def _nations(spark, sf):
    """Nations with nested metadata: an object, an array, a number as text, and a null for every other one."""
    key = F.col("n_nationkey")
    meta = F.concat(
        F.lit('{"a":{"k":'), (key % 3).cast("string"), F.lit(',"b":true},"tags":["t'), F.col("n_regionkey").cast("string"), F.lit('","x",'), key.cast("string"), F.lit('],"s":"'), key.cast("string"),
        F.lit('","v":'), F.when(key % 2 == 0, "null").otherwise(F.concat(key.cast("string"), F.lit(".0"))), F.lit("}"),
    )
    return table(spark, sf, "nation").select("n_nationkey", meta.alias("metadata"))


FILTERS = {"nested": {"a": {"k": 1}}, "two": {"a": {"k": 2, "b": True}}, "held": {"tags": ["x", "t1"]}, "number_held": {"tags": [7]}, "as_text": {"s": "5"}, "not_as_number": {"s": 5}, "none": {"v": None}, "same_number": {"v": 9}, "deeper": {"k": 1}, "absent": {"z": 1}}


@query("""
select n_nationkey, n_nationkey % 3 = 1 as nested, n_nationkey % 3 = 2 as two, n_regionkey = 1 as held, n_nationkey = 7 as number_held, n_nationkey = 5 as as_text, false as not_as_number,
  n_nationkey % 2 = 0 as "none", n_nationkey = 9 as same_number, false as deeper, false as absent from nation
""")
def json_containment(spark, sf):
    own = json_filter.parsed(F.col("metadata"))
    return _nations(spark, sf).select("n_nationkey", *(json_filter.contains(own, needle).alias(name) for name, needle in FILTERS.items()))


@query("select n_nationkey from nation where n_nationkey % 3 = 1 and n_regionkey = 1")
def json_filter_nested(spark, sf):
    return json_filter.filtered(_nations(spark, sf), '{"a": {"k": 1}, "tags": ["t1"]}').select("n_nationkey")


@query("select event_id % 4 = 1 or event_id % 4 = 2 as rejected, count(*) as n from events group by 1")
def valid_metadata(spark, sf):
    """Of four events one has its own metadata, one a list, one half of it, and one none."""
    kind = F.col("event_id") % 4
    own = table(spark, sf, "events").select("event_id", F.when(kind == 0, F.col("props")).when(kind == 1, "[1]").when(kind == 2, F.concat(F.col("props"), F.lit(","))).otherwise(" ").alias("metadata"))
    good, bad = catalog.valid_metadata(own)
    return good.select(F.lit(False).alias("rejected")).unionByName(bad.select(F.lit(True).alias("rejected"))).groupBy("rejected").agg(F.count(F.lit(1)).alias("n"))


@query("""
select cast(n_regionkey as bigint) as region, string_agg(case when n_nationkey % 3 = 0 then n_nationkey || ' | ' else n_nationkey || ' | ' || n_name end, chr(10) order by n_nationkey) as text
from nation where n_nationkey % 4 <> 2 group by n_regionkey
""")
def table_text(spark, sf):
    """Rows of a key and a padded name; every third is short of a cell, every fourth is blank."""
    key = F.col("n_nationkey")
    cells = F.when(key % 4 == 2, F.array(F.lit(" "), F.lit(None))).when(key % 3 == 0, F.array(key.cast("string"))).otherwise(F.array(key.cast("string"), F.concat(F.lit("  "), F.col("n_name"), F.lit("\t"))))
    rows = F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), cells.alias("c")))), lambda x: x["c"])
    return table(spark, sf, "nation").groupBy(F.col("n_regionkey").cast("long").alias("region")).agg(T.format_table(rows).alias("text"))


@query("""
with n as (select n_regionkey, n_nationkey, n_name, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as r from nation), c as (select n_regionkey, r, unnest([0, 1]) as c, n_nationkey, n_name from n)
select cast(n_regionkey as bigint) as region, cast(r as int) as "row", cast(c as int) as cell, case when c = 0 then n_nationkey::varchar else n_name end as text from c
""")
def html_tables(spark, sf):
    key = F.col("n_nationkey")
    row = F.concat(F.lit("<TR class='a'><th>"), key.cast("string"), F.lit("</th><td> "), F.col("n_name"), F.lit(" </td></TR>"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), row.alias("x")))), lambda x: x["x"]), "\n")
    pages = table(spark, sf, "nation").groupBy(F.col("n_regionkey").cast("long").alias("region")).agg(F.concat(F.lit("<p>x</p><table>"), rows, F.lit("</table><p>y</p>")).alias("html"))
    own = pages.select("region", F.explode(html.parsed(F.col("html"))["tables"]).alias("t")).select("region", F.posexplode("t").alias("row", "cells"))
    return own.select("region", "row", F.posexplode("cells").alias("cell", "text"))


@query("select doc_id, md5(text) as text from documents")
def decoded_text(spark, sf):
    """Every other text that Latin-1 can hold is given in Latin-1."""
    latin = (F.col("doc_id") % 2 == 1) & F.col("text").rlike(r"^[\x00-\x7F\xA0-\xFF]*$")
    given = F.when(latin, F.encode(F.when(latin, F.col("text")), "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return table(spark, sf, "documents").select("doc_id", F.md5(T.decoded(given)).alias("text"))


@query("select case doc_id % 5 when 0 then 'pdf' when 1 then 'docx' when 2 then 'unknown' when 3 then 'unknown' else 'html' end as file_type, doc_id % 5 not in (2, 3) as accepted, count(*) as n from documents group by all")
def accepted_files(spark, sf):
    kind = F.col("doc_id") % 5
    name = F.concat(F.lit("a.b"), F.col("doc_id").cast("string"), F.when(kind == 0, ".PDF").when(kind == 1, ".docx").when(kind == 2, ".exe").when(kind == 3, "").otherwise(".htm"))
    good, bad = files.accepted(table(spark, sf, "documents").select(T.file_type(name).alias("file_type")))
    return good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False))).groupBy("file_type", "accepted").agg(F.count(F.lit(1)).alias("n"))


@query("""
with t as (select doc_id, case doc_id % 4 when 0 then 'pdf' when 1 then 'docx' when 2 then 'png' else 'html' end as file_type, case (doc_id // 4) % 4 when 0 then 'local_parser' when 1 then 'local_ocr' when 2 then 'cloud_ocr' else 'hybrid' end as strategy from documents)
select doc_id, case when file_type = 'docx' then 1.0::double else 0.0 end as coverage, case when file_type in ('docx', 'png') then 1.0::double else 0.5 end as confidence, file_type = 'pdf' as local_captions, file_type = 'pdf' and strategy <> 'cloud_ocr' as cloud_captions, false as no_captions from t
""")
def routing_flags(spark, sf):
    n = F.col("doc_id")
    kind = F.when(n % 4 == 0, "pdf").when(n % 4 == 1, "docx").when(n % 4 == 2, "png").otherwise("html")
    k = F.floor(n / 4) % 4
    way = F.when(k == 0, routing.PARSER).when(k == 1, routing.LOCAL_OCR).when(k == 2, routing.CLOUD_OCR).otherwise(routing.HYBRID)
    coverage, confidence = routing.sample_defaults(kind)
    local, cloud = Settings(ocr=True), Settings(ocr=True, cloud_ocr=True, cloud_ready=True)
    return table(spark, sf, "documents").select("doc_id", coverage.cast("double").alias("coverage"), confidence.cast("double").alias("confidence"), routing.captions_wanted(kind, way, local).alias("local_captions"), routing.captions_wanted(kind, way, cloud).alias("cloud_captions"), routing.captions_wanted(kind, way, Settings()).alias("no_captions"))


@query("""
with t as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn) - 1 as k from conversations)
select conv_id, cast(k as int) as position, md5(text) as text, cast(turn as double) as first from t
""")
def aligned_vectors(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("turn", "text")))
    own = table(spark, sf, "conversations").groupBy("conv_id").agg(rows.alias("x"))
    both = catalog.aligned(F.transform("x", lambda r: r["text"]), F.transform("x", lambda r: F.array(r["turn"].cast("float"), F.lit(1.0).cast("float"))))
    return own.select("conv_id", F.explode(both).alias("e")).select("conv_id", "e.position", F.md5("e.text").alias("text"), F.get("e.vector", F.lit(0)).cast("double").alias("first"))


@query("select o_orderkey as id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as uploaded_at from orders order by o_orderdate desc nulls first, o_orderkey limit 100")
def listed_times(spark, sf):
    documents = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("uploaded_at"))
    chunks = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"))
    return catalog.listed(documents, chunks)[0].select("id", F.substring("uploaded_at", 1, 19).alias("uploaded_at"))


@query("select n_nationkey as id, n_name as name from nation where n_nationkey = 7")
def document_by_id(spark, sf):
    return catalog.got(table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), 7)


@query("select doc_id, case when doc_id % 3 = 0 then doc_id % 50 end as page, case when doc_id % 3 = 1 then (doc_id % 7)::varchar || '.' || (doc_id % 5)::varchar end as section from documents")
def page_and_section_marks(spark, sf):
    n = F.col("doc_id")
    line = F.when(n % 3 == 0, F.concat(F.col("lang"), F.lit(" Página "), (n % 50).cast("string"), F.lit(" z"))).when(n % 3 == 1, F.concat(F.lit("x Punto "), (n % 7).cast("string"), F.lit("."), (n % 5).cast("string"), F.lit(" y"))).otherwise(F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", T.page_mark(line).alias("page"), T.section_mark(line).alias("section"))


@query(f"select doc_id, md5(array_to_string({_WORDS}, ' ')) as lexemes, case when doc_id % 2 = 0 then '{{}}' else lang end as metadata from documents")
def backfill_lexemes(spark, sf):
    own = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"), F.lit(None).cast("array<string>").alias("content_lex"), F.when(F.col("doc_id") % 2 == 1, F.col("lang")).alias("metadata"))
    return catalog.backfilled_chunks(own, None).select("doc_id", F.md5(F.array_join("content_lex", " ")).alias("lexemes"), "metadata")


@query("""select doc_id, '{"lang":"' || lang || '"' || case when quality is not null then ',"quality":' || quality else '' end || '}' as metadata from documents left join labels using (doc_id)""")
def built_metadata(spark, sf):
    own = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return own.select("doc_id", catalog.built_metadata(lang=F.col("lang"), quality=F.col("quality")).alias("metadata"))


@query(f"select conv_id, md5(coalesce(string_agg(text, chr(10) order by turn) filter (where {_STRIPPED.format('text')} <> ''), '')) as text from conversations group by conv_id")
def layout_paragraphs(spark, sf):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda r: r["text"])
    own = table(spark, sf, "conversations").groupBy("conv_id").agg(F.concat(F.array(F.lit(" \t"), F.lit(None)), rows).alias("x"))
    return own.select("conv_id", F.md5(providers.paragraph_text(F.col("x"))).alias("text"))


@query(f"with t as (select doc_id, {_WORDS} as w from documents) select doc_id, cast(len(list_filter(w, lambda x: x in ('person', 'tiempo'))) as int) as hits from t")
def query_terms(spark, sf):
    """Unstemmed lexemes of texts against those of a question without a language."""
    terms = lexical.query_lexemes("Person, tiempo! PERSON", None)
    own = table(spark, sf, "documents").select("doc_id", lexical.lexemes(F.col("text"), None).alias("lex"))
    return own.select("doc_id", sum((lexical.frequency(F.col("lex"), t) for t in terms), F.lit(0)).cast("int").alias("hits"))


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


#: The words that `spanish_lexemes` leaves out, in place of the language's whole list.
STOPS = ("de", "el", "en", "la", "los", "y")

#: A word's stem: without its first ending that leaves three letters, then without accents, plural and final vowel.
_STEM = f"""
e as (select w, list_filter({_list(lexical.NOUN_ENDINGS + lexical.VERB_ENDINGS)}, lambda x: suffix(w, x) and len(w) - len(x) >= 3)[1] as x from (select distinct w from t)),
a as (select w, translate(case when x is null then w else w[:len(w) - len(x)] end, 'áéíóúü', 'aeiouu') as s from e),
p as (select w, case when len(s) > 4 and suffix(s, 'es') then s[:len(s) - 2] when len(s) > 3 and suffix(s, 's') then s[:len(s) - 1] else s end as s from a),
stems as (select w, case when len(s) > 3 and s[-1] in ('a', 'e', 'o') then s[:len(s) - 1] else s end as stem from p)
"""


@query(f"""
with d as (select doc_id, list_filter({_WORDS}, lambda x: not list_contains({_list(STOPS)}, x)) as w from documents),
t as (select doc_id, unnest(w) as w, unnest(range(len(w))) as i from d), {_STEM}
select d.doc_id, cast(count(stem) as int) as n, md5(coalesce(string_agg(stem, ' ' order by i), '')) as lexemes, cast(count(*) filter (where stem in ('person', 'tiemp')) as int) as hits
from d left join t using (doc_id) left join stems on stems.w = t.w group by d.doc_id
""")
def spanish_lexemes(spark, sf):
    """Stemmed lexemes of all texts, and how many are those of a question."""
    terms = lexical.query_lexemes("¿La persona y el TIEMPO, persona?", stops=STOPS, stemmer="light")
    own = table(spark, sf, "documents").select("doc_id", lexical.lexemes(F.col("text"), stops=STOPS, stemmer="light").alias("lex"))
    hits = sum((lexical.frequency(F.col("lex"), t) for t in terms), F.lit(0))
    return own.select("doc_id", F.size("lex").alias("n"), F.md5(F.array_join("lex", " ")).alias("lexemes"), hits.cast("int").alias("hits"))


@query("""
select case doc_id % 8 when 1 then 'unknown type' when 2 then 'metadata is no object' when 3 then 'no text' when 7 then 'AssertionError' else 'no reader' end as reason, count(*) as n from documents
where doc_id % 8 not in (0, 4) group by 1
""")
def rejected_files(spark, sf):
    """Of eight texts one is a file of unknown type, one has a list as metadata, one is blank, a pdf and an image have no
    reader, one page begins with markup that the parser gives up on; one is text, one HTML."""
    kind = F.col("doc_id") % 8
    name = F.concat(F.col("doc_id").cast("string"), F.when(kind == 1, ".exe").when(kind.isin(4, 7), ".html").when(kind == 5, ".pdf").when(kind == 6, ".png").otherwise(".txt"))
    content = F.encode(F.when(kind == 3, " \n\t").otherwise(F.concat(F.when(kind == 7, "<![foo[x]]>").otherwise("x "), F.col("text"))), "UTF-8")
    own = table(spark, sf, "documents").select(name.alias("filename"), T.file_type(name).alias("file_type"), content.alias("content"), F.when(kind == 2, "[1]").otherwise("{}").alias("metadata"))
    return ingest.rejected(own).withColumn("reason", F.substring_index("reason", ":", 1)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""
with p as (select conv_id, turn, case when turn % 4 = 3 then '' when turn % 4 = 1 then text || ' | ' else replace(replace(text, '|', ' '), chr(9), ' ') end as own, turn % 4 as k from conversations),
q as (select conv_id, turn, k, own || case when contains(own, '|') or contains(own, 'Tabla') or contains(own, 'CUOTA') or contains(own, 'COEF') or contains(own, 'CH ') or contains(own, 'CHALET')
  then chr(10) || chr(10) || '[Tabla 1]' || chr(10) || turn || ' | a' || chr(10) || chr(10) || chr(10) || '[Tabla 2]' || chr(10) || 'b' || chr(10) else '' end as x from p)
select conv_id, count(*) as pages, md5(coalesce(trim(string_agg(x, chr(10) order by turn) filter (where x <> ''), ' ' || chr(9) || chr(10) || chr(13)), '')) as text from q group by conv_id
""")
def pdf_text(spark, sf):
    """Conversations as parsed pdf files of a page a turn, each with two tables and a blank one; every fourth page is empty."""
    turn = F.col("turn")
    plain = F.translate("text", "|\t", "  ")
    text = F.when(turn % 4 == 3, "").when(turn % 4 == 1, F.concat("text", F.lit(" | "))).otherwise(plain)
    tables = F.array(F.array(F.array(turn.cast("string"), F.lit(" a "))), F.array(F.array(F.lit(" "))), F.array(F.array(F.lit("b"))))
    pages = table(spark, sf, "conversations").select("conv_id", (turn + 1).cast("int").alias("page_no"), text.alias("text"), tables.alias("tables"))
    own = files.pages_text(pages, "conv_id")
    return own.select("conv_id", F.col("extracted.pages_processed").cast("long").alias("pages"), F.md5("extracted.text").alias("text"))


@query("select doc_id, doc_id % 4 in (0, 1) as marked from documents")
def table_marks(spark, sf):
    """Marks of tables in either case, one without a number, and one that is not at the start."""
    n = F.col("doc_id")
    line = F.when(n % 4 == 0, F.concat(F.lit("[Tabla "), n.cast("string"), F.lit("] x"))).when(n % 4 == 1, "[TABLA  7]").when(n % 4 == 2, "[Tabla]").otherwise("x [Tabla 1]")
    return table(spark, sf, "documents").select("doc_id", line.rlike(T.TABLE_MARK).alias("marked"))


@query("""
with c as (select doc_id, unnest(range(3)) as chunk_index from documents)
select doc_id, cast(chunk_index as int) as chunk_index, case chunk_index when 0 then 'one ' || lang || chr(10) || 'three'
  when 1 then '[Tabla ' || doc_id || ']' || chr(10) || '| a ' || source || ' |' || chr(10) || '| b |' else 'after ' || doc_id || ' end' end as content
from c join documents using (doc_id)
""")
def marked_table_chunks(spark, sf):
    """A marked table ends at the blank line after it and is a chunk of its own where its neighbours don't fit beside it."""
    table_ = F.concat(F.lit("[Tabla "), F.col("doc_id").cast("string"), F.lit("]\n| a "), F.col("source"), F.lit(" |\n| b |\n\n"))
    text = F.concat(F.lit("one "), F.col("lang"), F.lit("\nthree\n"), table_, F.lit("after "), F.col("doc_id").cast("string"), F.lit(" end"))
    own = table(spark, sf, "documents").select("doc_id", chunking.paragraph_chunks(text, 10, 0).alias("c"))
    return own.select("doc_id", F.posexplode("c").alias("chunk_index", "content"))


@query("""
select doc_id, case doc_id % 4 when 0 then 'Page ' || doc_id % 9 || ' content' when 1 then 'Image on page ' || doc_id % 9 when 2 then 'Image on page unknown' else 'Image on page ' || doc_id % 9 end as caption,
  0.0::double as confidence from documents
""")
def caption_placeholders(spark, sf):
    """Captions without a model: of rendered pages, embedded images, images without a page and single photos."""
    n = F.col("doc_id")
    kind = F.when(n % 4 == 0, "full_page").when(n % 4 == 3, "photo").otherwise("embedded")
    own = table(spark, sf, "documents").select("doc_id", F.encode("lang", "UTF-8").alias("content"), F.when(n % 4 != 2, n % 9).alias("page"), kind.alias("type"))
    return providers.captioned(own, None).select("doc_id", F.regexp_replace("caption", r"[\[\]]", "").alias("caption"), "confidence")
