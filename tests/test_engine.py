from __future__ import annotations

import io
import json
import random
import re
import zipfile

import pytest
import specs
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkflow.config import Settings
from inkflow.functions import json_filter, lexical
from inkflow.functions import text as T
from inkflow.functions import tokens as K
from inkflow.functions.embedding import hashing_embedder
from inkflow.operators import blocks, captions, catalog, chunking, images, retrieval, routing, structure
from inkflow.plans.ingest import identified, ingest, rejected
from inkflow.sources import files, html
from inkflow.streaming.ingest import ingest_stream


def native(df) -> bool:
    return not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(2)


def random_text(seed: int) -> str:
    rng = random.Random(seed)
    out = []
    for _ in range(rng.randrange(1, 40)):
        words = " ".join(rng.choice(["uno", "dos. ", "tres!", "página", "PUNTO 3", "a|b", "x"]) for _ in range(rng.randrange(0, 14)))
        out.append(rng.choice(["", "", "# ", "## ", " # ", "- ", "1. ", "| a | b |", "[Tabla 1] ", "[tabla 2]", "Página 2 ", "Página 3 punto 3 ", "punto 4.1 ", "\n"]) + words)
    return "\n".join(out)


TEXTS = [random_text(k) for k in range(120)] + ["", " ", "\n", "one", "# h", "#", "a | b | c", "| a | b |\n| c | d |", "[Tabla 1]\na\nb\n\nafter\n[Tabla 2]\nc", "word " * 700 + "end. Next one. " * 60]


@pytest.mark.parametrize("most,overlap", [(12, 3), (30, 0), (9, 8)])
def test_folds(spark, most, overlap):
    c = F.col("text")
    df = texts(spark, TEXTS).select("doc_id", chunking.paragraph_chunks(c, most, overlap).alias("p"), chunking.sentence_chunks(c, most, overlap).alias("s"), chunking.embedding_pieces(c, most).alias("e"), K.windows(c, most, overlap).alias("w"))
    assert native(df)
    for r in df.collect():
        t = TEXTS[r.doc_id]
        assert r.w == specs.windows(t, most, overlap)
        assert r.s == specs.sentences(t, most, overlap)
        assert r.p == specs.paragraphs(t, most, overlap)
        assert r.e == specs.embedding_pieces(t, most)


@pytest.mark.parametrize("most,overlap,tables", [(12, 3, True), (30, 0, True), (9, 8, False)])
def test_sections(spark, most, overlap, tables):
    got: dict[int, list] = {}
    for r in chunking.semantic_chunks(texts(spark, TEXTS), "doc_id", most=most, overlap=overlap, tables=tables).orderBy("doc_id", "chunk_index").collect():
        assert r.chunk_index == len(got.setdefault(r.doc_id, []))
        got[r.doc_id].append(tuple(r)[2:])
    own: dict[int, list] = {}
    for r in structure.sections(texts(spark, TEXTS), "doc_id").orderBy("doc_id", "ordinal").collect():
        own.setdefault(r.doc_id, []).append({"type": r.type, "content": r.content, "level": r.level, "heading": r.heading})
    for k, t in enumerate(TEXTS):
        assert own[k] == specs.sections(t)
        assert got[k] == specs.section_chunks(t, most, overlap, tables)


def test_windows_of_tokens(spark):
    @settings(max_examples=25, deadline=None)
    @given(st.lists(st.integers(0, 60), min_size=1, max_size=8), st.integers(1, 20), st.data())
    def check(sizes, size, data):
        overlap = data.draw(st.integers(0, size - 1))
        rows = texts(spark, [" ".join(map(str, range(k))) for k in sizes]).select("doc_id", K.windows(F.col("text"), size, overlap).alias("w"))
        for r in rows.collect():
            k = sizes[r.doc_id]
            step = size - overlap
            assert len(r.w) == (1 if k <= size else -(-k // step))
            assert "".join(x if i == 0 else "".join(specs.toks(x)[overlap:]) for i, x in enumerate(r.w)) == " ".join(map(str, range(k)))

    check()
    with pytest.raises(ValueError):
        K.windows(F.lit("x"), 5, 5)


def test_split_for_embedding(spark):
    chunks = spark.createDataFrame([("d", 0, "a. " * 30), ("d", 1, "short"), ("d", 2, "b. " * 5)], "document_id string, chunk_index int, content string")
    rows = chunking.split_for_embedding(chunks, most=10).orderBy("original_chunk_index", "split_index").collect()
    first = [r for r in rows if r.original_chunk_index == 0]
    assert [r.chunk_index for r in first] == list(range(len(first))) and all(r.is_split for r in first)
    assert [(r.chunk_index, r.is_split) for r in rows if r.original_chunk_index == 1] == [(1, False)]


CAPTIONS = [(1, "uno"), (3, "tres"), (2, "dos punto 3"), (3, "otra"), (None, "sin"), (99, "fin"), (50, "cincuenta")]


def test_captions(spark):
    df = texts(spark, TEXTS)
    caps = df.select("doc_id").crossJoin(spark.createDataFrame([(k, *c) for k, c in enumerate(CAPTIONS)], "ordinal int, page int, caption string")).filter("doc_id % 5 <> 4")
    for r in captions.injected(df, caps).collect():
        assert r.text == specs.inject(TEXTS[r.doc_id], CAPTIONS if r.doc_id % 5 != 4 else [])


FILTERS = [{}, {"a": 1}, {"a": 1.0}, {"a": "1"}, {"a": None}, {"a": True}, {"t": ["x"]}, {"t": ["y", "x", "x"]}, {"t": []}, {"o": {"k": "v"}}, {"o": {}}, {"a.b": 5}, {"k": "v"}, {"a": 1, "t": ["x"]}, {"l": [{"i": 2}]}, {"big": 9007199254740993}, {"it's": 1}, {"T": ["x"]}]
METADATA = [{}, {"a": 1}, {"a": 1.5}, {"a": 1.0}, {"a": "1"}, {"a": None}, {"a": True}, {"t": ["x", "y"], "a": 1}, {"t": "x"}, {"o": {"k": "v", "z": 1}}, {"a.b": 5}, {"a": {"b": 5}}, {"l": [{"i": 1}, {"i": 2, "j": 0}]}, {"big": 9007199254740992}, {"big": 9007199254740993}, {"it's": 1}, {"t": [["x"]]}]


def test_containment(spark):
    df = spark.createDataFrame([(k, json.dumps(m)) for k, m in enumerate(METADATA)] + [(100, None), (101, "not json"), (102, "[1]")], "id int, metadata string")
    for f in FILTERS:
        got = {r.id for r in json_filter.filtered(df, f).collect()}
        want = {k for k, m in enumerate(METADATA) if specs.contains(m, f)} | (set() if f else {100, 101, 102})
        assert got == want, f
    with pytest.raises(ValueError):
        json_filter.filtered(df, [1])
    kept, rejected = catalog.valid_metadata(df.union(spark.createDataFrame([(103, "  ")], "id int, metadata string")))
    assert {r.id for r in rejected.collect()} == {101, 102} and {r.metadata for r in kept.filter("id in (100, 103)").collect()} == {"{}"}


def test_rankings(spark):
    rows = [("3,1,0,2,4", 5), ("2, 2, 9", 4), ("none", 3), ("", 2), (None, 2), ("-1 99999999999999 0", 3), ("1", 0)]
    for r in spark.createDataFrame(rows, "r string, n int").select("*", T.parse_ranking(F.col("r"), F.col("n")).alias("o")).collect():
        assert r.o == specs.ranking(r.r or "", r.n)


def test_scalars(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c.alias("x")).first()["x"]

    assert [value(T.file_type(F.lit(x))) for x in ("a.PDF", "x.doc", "y.htm", "z.jpg", "t.tif", "pdf", "a.b.docx", "", None, "x.exe")] == ["pdf", "docx", "html", "jpeg", "tiff", "pdf", "docx", "unknown", "unknown", "unknown"]
    assert value(T.decoded(F.lit("é".encode()))) == "é" == value(T.decoded(F.lit("é".encode("latin-1"))))
    assert value(T.clean_table_row(F.lit("a | b | c"), True)) == "| b |" and value(T.clean_table_row(F.lit("a | b|c"))) == "| a | b | c |" == value(T.clean_table_row(F.lit(" |a|b | c| ")))
    assert value(T.preview(F.lit("x" * 201))) == "x" * 200 + "..." and value(T.preview(F.lit("x" * 200))) == "x" * 200
    table = F.array(F.array(F.lit(" a "), F.lit("b")), F.array(F.lit(" "), F.lit(None)), F.array(F.lit("c")))
    assert value(T.format_table(table)) == "a | b\nc | "
    assert [value(T.effective_k(F.lit(q), F.lit(k), 10, 15)) for q, k in (("sobre el Sistema", 3), ("hola", None), ("hola", 0), ("punto 3", 20))] == [15, 10, 10, 20]
    assert value(T.strip(F.lit("\xa0\t x \n"))) == "x"
    assert value(T.merged_metadata(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), None or F.create_map(F.lit("a"), F.lit("3")))) == {"a": "3", "b": "2"}
    for blank, h, t, want in (("", 0, 0, 0.0), ("x", 0, 0, 0.855), ("x", 1, 0, 0.95), ("x", 0, 1, 0.9), ("x", 1, 1, 1.0)):
        assert value(T.quality_score(F.lit(blank), F.lit(h), F.lit(t))) == pytest.approx(want)


@pytest.mark.parametrize("ocr,cloud", [(False, False), (True, False), (True, True)])
def test_routing_grid(spark, ocr, cloud):
    def way(kind, coverage, pages, layout):
        if kind in ("docx", "html", "txt") or not ocr:
            return "local_parser"
        if cloud and (layout != "simple" or pages >= 5):
            return "cloud_ocr"
        if coverage >= 0.5:
            return "local_parser"
        if layout == "complex" or coverage < 0.1:
            return "local_ocr"
        return "hybrid"

    grid = [(k, c, p, x) for k in ("pdf", "docx", "txt", "png") for c in (0.0, 0.0999, 0.1, 0.3, 0.5, 1.0) for p in (1, 4, 5) for x in ("simple", "moderate", "complex")]
    df = spark.createDataFrame(grid, "kind string, coverage double, pages int, layout string")
    own = Settings(ocr=ocr, cloud_ocr=cloud, cloud_ready=cloud)
    for r in df.select("*", routing.strategy(F.col("kind"), F.col("coverage"), F.col("pages"), F.col("layout"), own).alias("s")).collect():
        assert r.s == way(r.kind, r.coverage, r.pages, r.layout), r


def test_layouts_and_coverage(spark):
    rows = [("pdf", "plain text", "simple"), ("pdf", "a form here", "moderate"), ("pdf", "form with signature", "complex"), ("pdf", "a|b\n" + "x" * 40, "complex"), ("pdf", "a|" + "b" * 40 + "\n" + "x" * 40, "moderate"), ("html", "form signature", "simple"), ("pdf", "a\tb" + "x" * 40, "moderate")]
    for r in spark.createDataFrame(rows, "k string, t string, want string").select("*", routing.layout_class(F.col("k"), F.col("t")).alias("got")).collect():
        assert r.got == r.want, r
    pages = spark.createDataFrame([(1, 1, "x" * 50), (1, 2, "x" * 49), (2, 1, " " * 60), (3, 1, "y" * 60), (3, 2, "y" * 60), (3, 3, None), (3, 4, "y" * 60)], "d int, page_no int, text string")
    got = {r.d: (r.page_count, round(r.coverage, 3), round(r.confidence, 3)) for r in routing.text_coverage(pages, "d").collect()}
    assert got == {1: (2, 0.5, 0.667), 2: (1, 0.0, 0.333), 3: (4, 0.667, 1.0)}


def test_images(spark):
    rows = [(1, 1, "embedded", 99, 500), (1, 2, "embedded", 200, 300), (1, 3, "embedded", 299, 300), (1, 4, "embedded", 300, 300), (1, 5, "full_page", 1, 1), (1, 6, "embedded", 400, 0), (1, 7, "embedded", 500, 250), (1, 8, "full_page", None, None)]
    df = spark.createDataFrame(rows, "d int, ordinal int, type string, width int, height int")
    assert [r.ordinal for r in images.chosen_images(df, "d").orderBy("rank").collect()] == [5, 8, 2, 4, 7]
    assert [r.ordinal for r in images.chosen_images(df, "d", most=3).orderBy("rank").collect()] == [5, 8, 2]
    assert [r.ordinal for r in images.chosen_images(df, "d", most=1).orderBy("rank").collect()] == [5, 8]


def test_blocks(spark):
    schema = "doc_id int, ordinal int, id string, block_type string, page int, row_index int, column_index int, text string, child_ids array<string>"
    rows = [
        (1, 0, "l1", "LINE", 1, None, None, "first", None), (1, 1, "l2", "LINE", 2, None, None, "second", None), (1, 2, "l3", "LINE", None, None, None, "third", None),
        (1, 3, "t", "TABLE", 2, None, None, None, ["c1", "c2", "c3", "gone"]), (1, 4, "c1", "CELL", 2, 1, 1, None, ["w1", "w2", "gone"]), (1, 5, "c2", "CELL", 2, 2, 3, None, ["w3"]), (1, 6, "c3", "CELL", 2, 1, 1, None, ["w3"]),
        (1, 7, "w1", "WORD", 2, None, None, "hello", None), (1, 8, "w2", "WORD", 2, None, None, "world", None), (1, 9, "w3", "WORD", 2, None, None, "x", None), (2, 0, "l", "LINE", 1, None, None, "only", None),
    ]
    out = {r.doc_id: r for r in blocks.extracted_blocks(spark.createDataFrame(rows, schema)).collect()}
    assert out[1].text == "first\n\n[Página 2]\n\nsecond\nthird" and out[1].pages_processed == 2
    assert out[1].tables == [[["hello world", "", ""], ["", "", "x"]]] and out[2].tables == []


def test_context(spark):
    rows = [(1, 0, "a " * 5), (1, 1, "b " * 5), (1, 2, ""), (1, 3, "c"), (1, 4, ""), (2, 0, "d " * 11), (2, 1, "e")]
    df = spark.createDataFrame(rows, "q int, rank int, content string")
    assert [(r.q, r.rank) for r in retrieval.packed_context(df, "q", most=10).orderBy("q", "rank").collect()] == [(1, 0), (1, 1), (1, 2)]


def corpus(spark):
    embed = hashing_embedder(8)
    rows = [("a", "d1", 0, "el gato come pescado", {"tenant": "x"}), ("b", "d1", 1, "el perro come carne PUNTO 3", {"tenant": "y"}), ("c", "d2", 0, "nada que ver aquí", {"tenant": "x"}), ("e", "d2", 1, "gatos y gatas", {"tenant": "x"})]
    df = spark.createDataFrame([(i, d, k, t, [float(v) for v in embed([t])[0]], json.dumps(m)) for i, d, k, t, m in rows], "id string, document_id string, chunk_index int, content string, embedding array<float>, metadata string")
    return df.withColumn("content_lex", F.when(F.col("id") != "c", lexical.lexemes(F.col("content")))), lambda q: embed([q])[0]


def test_answers(spark):
    chunks, embed = corpus(spark)
    out = retrieval.answer(chunks, retrieval.Request("¿Qué come el gato?", {"tenant": "x"}, 2), embed, lambda m, k: m[1]["content"])
    assert out["chunks"][0]["chunk_id"] == "a" and len(out["chunks"]) == 2 and "el gato come pescado" in out["answer"]
    own = Settings(reranking=True)
    turned = retrieval.answer(chunks, retrieval.Request("gato"), embed, lambda m, k: "ok", lambda m: "3, 2", own)
    plain = retrieval.answer(chunks, retrieval.Request("gato"), embed, lambda m, k: "ok")
    assert [c["chunk_id"] for c in turned["chunks"]] == [plain["chunks"][k]["chunk_id"] for k in (3, 2, 0, 1)]
    failing = retrieval.answer(chunks, retrieval.Request("gato"), embed, lambda m, k: "ok", lambda m: 1 / 0, own)
    assert failing["chunks"] == plain["chunks"]
    assert retrieval.answer(chunks, retrieval.Request("gato", {"tenant": "nobody"}), embed, lambda m, k: "ok") == {"answer": retrieval.NO_ANSWER, "chunks": []}
    assert len(retrieval.search(chunks, retrieval.Request(" "), embed).collect()) == 4
    for bad in ({"question": ""}, {"question": "x", "top_k": 0}, {"question": "x", "system_prompt": "y" * 2001}, {"question": "x", "filters": [1]}):
        with pytest.raises(ValueError):
            retrieval.Request(**bad)


def test_lexical(spark):
    assert lexical.query_lexemes("Los gatos comían") == lexical.query_lexemes("gato comía") and lexical.query_lexemes("el de la") == []
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None)], "id int, lex array<string>")
    got = {r.id: r.lexical for r in lexical.bm25(df, "lex", ["a"]).collect()}
    assert got[1] > 0 and got[2] == 0 and got[3] is None
    assert {r.id: r.s for r in df.select("id", lexical.tf_score(F.col("lex"), ["a"]).alias("s")).collect()} == {1: pytest.approx(2 / 3), 2: 0.0, 3: None}


def test_hybrid_plan_is_a_projection_and_a_top_k(spark):
    chunks, embed = corpus(spark)
    plain = chunks.withColumn("content_lex", lexical.lexemes(F.col("content"), stemmed=False))
    found = retrieval.hybrid_search(plain, embed("gato"), ["gato"], 2, scorer="tf")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and native(found) and "Exchange" not in plan.replace("TakeOrdered", "")


def docx(paragraphs, rows) -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in paragraphs)
    t = "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p}<w:tbl>{t}</w:tbl></w:body></w:document>")
    return out.getvalue()


HTML = "<html><head><style>p{}</style><script>var t='</p>';</script></head><body><h1> Title </h1><!-- no --><p>one<b>two</b></p><table><tr></tr><tr><th>A</th><td> b &amp; c </td></tr></table><table></table></body></html>"


def test_html():
    text, tables, error = html.read(HTML)
    assert error is None
    assert text == "Title\none\ntwo\nA\nb & c" and tables == [[["A", "b & c"]]]
    assert html.read(None) == ("", [], None) == html.read("<script>x")
    assert html.read("<p>a</p><![foo[x]]>b")[0] == "a" and html.read("<p>a</p><![foo[x]]>b")[2]
    assert html.read("<table><tr><td>o<table><tr><td>i</td></tr></table></td><td>z</td></tr></table>")[1][1] == [["i"]]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one file.txt").write_text("# Uno\nel gato come.\n\n# Dos\n| a | b |\n| c | d |\nfin")
    (tmp_path / "in/page.htm").write_text(HTML)
    (tmp_path / "in/w.docx").write_bytes(docx(["First", " ", "Second"], [["x", "y"], ["z"]]))
    (tmp_path / "in/l.TXT").write_bytes("sí señor".encode("latin-1"))
    (tmp_path / "in/blank.txt").write_text("  \n")
    (tmp_path / "in/no.exe").write_bytes(b"MZ")
    return tmp_path


def test_ingest(spark, folder):
    found = files.read_files(spark, str(folder / "in")).withColumn("metadata", F.lit('{"tenant": "x", "n": {"k": [1]}, "quality_score": "mine"}'))
    documents, chunks = ingest(found, Settings(chunk_max_tokens=6, chunk_overlap=2, chunk_size=6))
    docs = {r.filename: r for r in documents.collect()}
    assert set(docs) == {"one file.txt", "page.htm", "w.docx", "l.TXT"}
    meta = json.loads(docs["one file.txt"].metadata)
    assert meta == {"tenant": "x", "n": {"k": [1]}, "quality_score": 1.0, "extraction_strategy": "local_parser", "pages_processed": 1, "image_captions_count": 0}
    rows = chunks.collect()
    by = {k: sorted((r for r in rows if r.document_id == d.id), key=lambda r: r.chunk_index) for k, d in docs.items()}
    # one section: its table lines have one pipe each, and sections are never split
    assert [r.content for r in by["w.docx"]] == ["First\nSecond\n\n[Tabla]\nx | y\nz |"]
    assert by["l.TXT"][0].content == "sí señor" and len(by["l.TXT"][0].embedding) == 64
    own = json.loads(by["one file.txt"][0].metadata)
    assert own["tenant"] == "x" and own["section"] == "Uno" and own["has_heading"] is True and own["sections"] == 1 and own["n"] == {"k": [1]}
    assert {r.id for r in json_filter.filtered(chunks, {"tenant": "x", "n": {"k": [1]}}).collect()} == {r.id for r in rows}


def test_pdf_and_ocr_by_providers(spark, monkeypatch):
    monkeypatch.setattr(files, "PROVIDERS", {})
    files.register("pdf", "default", lambda content: [(x, [[["CH 1", "2"]]]) for x in content.decode().split("\f")])
    files.register("ocr", "default", lambda content, kind: ["scanned"])
    rows = [("a.pdf", "pdf", bytearray(("x" * 60 + "\f" + "CUOTA y").encode()), "{}"), ("s.pdf", "pdf", bytearray(b" "), "{}"), ("i.png", "png", bytearray(b"p"), "{}"), ("t.txt", "txt", bytearray(b"text"), "{}")]
    df = spark.createDataFrame(rows, "filename string, file_type string, content binary, metadata string").withColumn("uploaded_at", F.lit(None).cast("timestamp"))
    caps = spark.createDataFrame([("a.pdf", 0, 1, "una imagen")], "filename string, ordinal int, page int, caption string")
    documents, chunks = ingest(df, Settings(ocr=True), image_captions=caps)
    meta = {r.filename: json.loads(r.metadata) for r in documents.collect()}
    assert {k: m["extraction_strategy"] for k, m in meta.items()} == {"a.pdf": "local_parser", "s.pdf": "local_ocr", "i.png": "local_ocr", "t.txt": "local_parser"}
    assert meta["a.pdf"]["image_captions_count"] == 1 and meta["a.pdf"]["pages_processed"] == 2
    content = "\n".join(r.content for r in chunks.collect())
    assert "[Contenido visual de la página 1]: una imagen" in content and "[Tabla 1]\nCH 1 | 2" in content and "[Página 1]\nscanned" in content
    with pytest.raises(ValueError):
        files.provider("ocr", "other")


def test_cloud_falls_back_and_bad_files_stay_out(spark, monkeypatch, tmp_path):
    """A cloud reads what routing gives it and local OCR what it refuses; each file is read once; rejected files have reasons."""
    calls = tmp_path / "calls"
    calls.mkdir()

    def cloud(content, kind):
        open(calls / f"{hash(bytes(content))}-{random.random()}", "w").close()
        if content.startswith(b"big"):
            raise RuntimeError("too big")
        return ["by cloud"]

    def local(content, kind):
        if content.endswith(b"bad"):
            raise ValueError("unreadable")
        return ["by local"]

    monkeypatch.setattr(files, "PROVIDERS", {})
    files.register("ocr", "aws", cloud)
    files.register("ocr", "default", local)
    contents = {"a.pdf": b"a", "big.pdf": b"big", "big2.pdf": b"big bad", "x.docx": b"no zip", "e.txt": b" ", "u.exe": b"x", "m.txt": b"text", "t.txt": b"text"}
    rows = [(n, n.rpartition(".")[2].replace("exe", "unknown"), bytearray(c), "[1]" if n == "m.txt" else "{}") for n, c in contents.items()]
    df = spark.createDataFrame(rows, "filename string, file_type string, content binary, metadata string").withColumn("uploaded_at", F.lit(None).cast("timestamp"))
    settings, stage = Settings(ocr=True, cloud_ocr=True, cloud_ready=True, cloud="aws"), f"{tmp_path}/stage"
    pages = identified(df).filter("file_type = 'pdf'").select("id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("page_no"), F.lit("").alias("text"), F.array().cast(files.TABLES).alias("tables"))
    documents, chunks = ingest(df, settings, pages=pages, stage=stage)
    meta = {r.filename: json.loads(r.metadata) for r in documents.collect()}
    names = {r.id: r.filename for r in documents.collect()}
    assert {names[r.document_id]: r.content for r in chunks.collect()} == {"a.pdf": "[Página 1]\nby cloud", "big.pdf": "[Página 1]\nby local", "t.txt": "text"} and set(meta) == {"a.pdf", "big.pdf", "t.txt"}
    assert len(list(calls.iterdir())) == 3
    confidence = {r.filename: r.c for r in spark.read.parquet(stage).select("filename", F.col("extracted.confidence").alias("c")).collect()}
    assert confidence["a.pdf"] == 0.95 and confidence["big.pdf"] == 0.85 and confidence["t.txt"] == 1.0
    reasons = {r.filename: r.reason for r in rejected(df, settings, stage=stage).collect()}
    assert reasons == {"big2.pdf": "ValueError: unreadable", "x.docx": "BadZipFile: File is not a zip file", "e.txt": "no text", "u.exe": "unknown type", "m.txt": "metadata is no object"}
    caps = identified(df).filter("filename = 'a.pdf'").select("id", F.lit(0).alias("ordinal"), F.lit(1).alias("page"), F.lit("una").alias("caption"))
    assert {r.filename for r in ingest(df, settings, pages=pages, image_captions=caps)[0].collect()} == set(meta)


def test_catalogue_of_tables(spark, folder):
    for name in ("t_documents", "t_document_chunks"):
        spark.sql(f"drop table if exists {name}")
    ingest_stream(spark, str(folder / "in"), str(folder / "state"), "t_").awaitTermination()
    assert spark.table("t_documents").count() == 4
    (folder / "in/new.txt").write_text("otro documento")
    ingest_stream(spark, str(folder / "in"), str(folder / "state"), "t_").awaitTermination()
    documents, chunks = spark.table("t_documents"), spark.table("t_document_chunks")
    page, total = catalog.listed(documents, chunks, 2, 1)
    assert total == 5 and page.count() == 2 and all(r.chunk_count >= 1 for r in page.collect())
    one = documents.first()["id"]
    assert catalog.delete(spark, one, "t_") and not catalog.delete(spark, one, "t_")
    assert spark.table("t_documents").count() == 4 and spark.table("t_document_chunks").filter(F.col("document_id") == one).count() == 0
    for name in ("t_documents", "t_document_chunks"):
        spark.sql(f"drop table if exists {name}")


def test_backfills_and_pages(spark):
    df = spark.createDataFrame([("a", None, None), ("b", "{}", 1), ("c", None, 1)], "id string, metadata string, t int").withColumn("uploaded_at", F.col("t").cast("timestamp"))
    assert [r.metadata for r in catalog.backfilled_documents(df).collect()] == ["{}"] * 3
    assert catalog.null_counts(df, "metadata").first()["null_metadata"] == 2
    assert [r.id for r in catalog.page_of_documents(df, 2).collect()] == ["a", "b"] and [r.id for r in catalog.page_of_documents(df, 5, 2).collect()] == ["c"]
    with pytest.raises(ValueError):
        catalog.page_of_documents(df, 0)
    chunks = spark.createDataFrame([(1, "los gatos")], "id int, content string")
    assert catalog.backfilled_chunks(chunks).first()["content_lex"] == lexical.query_lexemes("gatos")


def test_providers(spark, monkeypatch):
    from inkflow.sources import providers

    monkeypatch.setattr(files, "PROVIDERS", {})
    files.register("ocr", "aws", lambda content, kind: ["aws"])
    files.register("ocr", "default", lambda content, kind: ["local"])
    with pytest.raises(ValueError):
        providers.cloud_reader("gcp")
    with pytest.raises(ValueError):
        providers.cloud_reader("aws", credentials=False)
    read = providers.first_of(providers.cloud_reader("aws"), files.provider("ocr", "default"))
    assert read(b"x", "pdf") == ["aws"] and read(b"x" * (providers.SYNC_BYTES + 1), "pdf") == ["local"]
    files.register("caption", "default", lambda content: {b"a": "una casa"}[bytes(content)])
    rows = [(1, bytearray(b"a"), 1, "photo"), (2, bytearray(b"b"), 2, "full_page"), (3, None, None, "embedded"), (4, None, 4, "full_page")]
    df = spark.createDataFrame(rows, "id int, content binary, page int, type string")
    got = {r.id: (r.caption, r.confidence) for r in providers.captioned(df).collect()}
    assert got == {1: ("una casa", 0.95), 2: ("[Page 2 content - extraction failed]", 0.0), 3: ("[Image on page unknown]", 0.0), 4: ("[Page 4 content - extraction failed]", 0.0)}
    assert [r.caption for r in providers.captioned(df, None).orderBy("id").collect()] == ["[Image on page 1]", "[Page 2 content]", "[Image on page unknown]", "[Page 4 content]"]


def test_hashed_neighbours(spark, sf):
    """Recall of the ten nearest by hashing against all distances."""
    from inkflow.operators import index

    own = spark.read.parquet(f"{sf}/embeddings.parquet").withColumnRenamed("vec_id", "id")
    model, hits = index.fit_lsh(own), 0
    for r in own.filter("id % 50 = 0").collect():
        exact = {x.id for x in retrieval.vector_search(own, r.embedding, 10, "l2").collect()}
        hits += len(exact & {x.id for x in index.near(own, model, r.embedding, 10).collect()})
    assert hits >= 0.9 * 10 * own.filter("id % 50 = 0").count()


def test_coded_neighbours(spark, sf, tmp_path):
    """Codes find the ten nearest; the scan for candidates reads no embedding; null, zero and few vectors are no error."""
    from inkflow.operators import index

    own = spark.read.parquet(f"{sf}/embeddings.parquet").withColumnRenamed("vec_id", "id")
    index.quantised(own).write.parquet(f"{tmp_path}/coded")
    coded, hits = spark.read.parquet(f"{tmp_path}/coded"), 0
    for r in own.filter("id % 100 = 0").collect():
        exact = {x.id for x in retrieval.vector_search(own, r.embedding, 10, "l2").collect()}
        found = index.near_by_code(coded, r.embedding, 10)
        hits += len(exact & {x.id for x in found.collect()})
    assert hits >= 0.99 * 10 * own.filter("id % 100 = 0").count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = set(re.findall(r"FileScan parquet \[([^\]]*)\]", plan))
    assert sorted("embedding" in x for x in scans) == [False, True] and all(("code" in x) != ("embedding" in x) for x in scans)
    odd = index.quantised(spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (3, [1.0, -3.0])], "id long, embedding array<float>"))
    assert [r.id for r in index.near_by_code(odd, [0.0, 1.0], 5).collect()] == [2, 3]
    many = index.near_by_code_many(odd, spark.createDataFrame([(7, [1.0, -3.0]), (8, None)], "query_id long, embedding array<float>"), 1)
    assert [(r.query_id, r.id, r.distance) for r in many.collect()] == [(7, 3, 0.0)]


def test_aligned_and_inherited(spark):
    one = spark.range(1)
    texts_, good, bad = F.array(F.lit("a"), F.lit("b")), F.array(F.array(F.lit(1.0)), F.array(F.lit(2.0))).cast("array<array<float>>"), F.array(F.array(F.lit(1.0))).cast("array<array<float>>")
    assert [(x.position, x.text, x.vector) for x in one.select(catalog.aligned(texts_, good).alias("x")).first()["x"]] == [(0, "a", [1.0]), (1, "b", [2.0])]
    with pytest.raises(Exception, match="differ in number"):
        one.select(catalog.aligned(texts_, bad)).collect()
    documents = spark.createDataFrame([("d", "new"), ("n", None)], "id string, metadata string")
    chunks = spark.createDataFrame([("d", 0, "old"), ("n", 0, "old"), ("x", 0, "old")], "document_id string, id int, metadata string")
    assert sorted((r.document_id, r.metadata or "") for r in catalog.inherited(chunks, documents).collect()) == [("d", "new"), ("n", ""), ("x", "old")]
    assert one.select(catalog.built_metadata(a=F.lit(1), b=F.lit("x")).alias("m")).first()["m"] == '{"a":1,"b":"x"}'
