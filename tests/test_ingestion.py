"""No file is lost: documents and rejects partition what was put in, in one plan and in a stream that is run again."""

from __future__ import annotations

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkflow.config import Settings
from inkflow.operators import catalog
from inkflow.plans.ingest import identified, ingest, rejected
from inkflow.sources import files, providers
from inkflow.streaming.ingest import ingest_stream

CONTENTS = {
    "a.txt": b"uno dos", "b.pdf": b"%PDF", "c.png": b"\x89PNG", "d.exe": b"x", "e.html": b"<p>a</p><![foo[x]]>b", "f.html": b"<![foo[x]]>", "g.docx": b"no zip", "h.txt": b" \n", "i.html": b"<p>hola</p>", "j.tiff": b"II",
}


@pytest.fixture
def rows(spark):
    own = [(n, bytearray(c), "{}") for n, c in CONTENTS.items()]
    from inkflow.functions import text as T

    df = spark.createDataFrame(own, "filename string, content binary, metadata string")
    return df.withColumn("file_type", T.file_type(F.col("filename"))).withColumn("uploaded_at", F.lit(None).cast("timestamp"))


@pytest.mark.parametrize("ocr", [False, True])
@pytest.mark.parametrize("reader", [None, "ocr", "pdf"])
def test_documents_and_rejects_partition_the_files(spark, monkeypatch, rows, ocr, reader):
    monkeypatch.setattr(files, "PROVIDERS", {})
    if reader == "ocr":
        files.register("ocr", "default", lambda content, kind: [f"read {kind}"])
    if reader == "pdf":
        files.register("pdf", "default", lambda content: [("a page", [])])
    settings = Settings(ocr=ocr)
    good = [r.filename for r in ingest(rows, settings)[0].collect()]
    bad = {r.filename: r.reason for r in rejected(rows, settings).collect()}
    assert sorted(good + list(bad)) == sorted(CONTENTS)
    assert {"a.txt", "e.html", "i.html"} <= set(good) and bad["d.exe"] == "unknown type" and bad["h.txt"] == "no text"
    assert bad["f.html"].startswith("AssertionError") and bad["g.docx"].startswith("BadZipFile")
    seen = {"b.pdf", "c.png", "j.tiff"} & set(good)
    assert seen == ({"b.pdf", "c.png", "j.tiff"} if ocr and reader == "ocr" else {"b.pdf"} if reader == "pdf" else set())
    assert all(bad[n] == "no reader" for n in {"b.pdf", "c.png", "j.tiff"} - seen)


def test_pdf_without_pages_is_rejected(spark, rows):
    pages = spark.createDataFrame([], f"id string, page_no int, text string, tables {files.TABLES}")
    assert {r.filename: r.reason for r in rejected(rows, pages=pages).collect()}["b.pdf"] == "no page could be read"
    read = identified(rows).filter("filename = 'b.pdf'").select("id", F.lit(1).alias("page_no"), F.lit("texto").alias("text"), F.array().cast(files.TABLES).alias("tables"))
    assert "b.pdf" in {r.filename for r in ingest(rows, pages=read)[0].collect()}


def test_a_file_without_images_does_not_stop_others(spark, monkeypatch, rows):
    monkeypatch.setattr(files, "PROVIDERS", {})
    files.register("images", "default", lambda content, kind: 1 // 0)
    got = providers.images_of(rows, "filename").collect()
    assert {r.filename for r in got} == {"c.png", "j.tiff"}


def test_stream_has_each_file_once(spark, tmp_path, monkeypatch):
    """Also if a batch stops after its documents are written, before its rejects are."""
    tables = ("documents", "document_chunks", "rejects", "ingested_files")
    for t in tables:
        spark.sql(f"drop table if exists q_{t}")
    folder, state = tmp_path / "in", str(tmp_path / "state")
    (folder / "sub").mkdir(parents=True)
    for name, content in CONTENTS.items():
        (folder / name).write_bytes(content)
    (folder / "sub" / "a.txt").write_bytes(CONTENTS["a.txt"])
    (folder / "a.txt.meta.json").write_text('{"tema": "uno"}')
    (folder / "i.html.meta.json").write_text("[1]")

    def run():
        ingest_stream(spark, str(folder), state, "q_", '{"de": "todos"}', most_files=12).awaitTermination()
        return {t: spark.table(f"q_{t}").collect() for t in tables}

    real = catalog.insert

    def stops(session, table, rows):
        if table == "q_rejects":
            raise RuntimeError("lost")
        real(session, table, rows)

    monkeypatch.setattr(catalog, "insert", stops)
    with pytest.raises(Exception, match="lost"):
        run()
    assert spark.table("q_documents").count() > 0 == spark.table("q_ingested_files").count()
    monkeypatch.setattr(catalog, "insert", real)
    first = run()
    assert run() == first
    (folder / "neu.txt").write_text("otro")
    (folder / "neu2.exe").write_text("otro")
    last = run()
    assert len(last["ingested_files"]) == len(CONTENTS) + 3
    names = Counter(r.filename for t in ("documents", "rejects") for r in last[t])
    assert names == Counter([*CONTENTS, "neu.txt", "neu2.exe"])
    meta = {r.filename: json.loads(r.metadata) for r in last["documents"]}
    assert meta["neu.txt"]["de"] == "todos" and {r.reason for r in last["rejects"] if r.filename == "i.html"} == {"metadata is no object"}
    assert meta["a.txt"].get("tema", meta["a.txt"].get("de")) in ("uno", "todos")
    assert {r.document_id for r in last["document_chunks"]} == {r.id for r in last["documents"]}
    outcomes = {r.path.rpartition("/")[2]: r.outcome for r in last["ingested_files"]}
    assert outcomes["b.pdf"] == "no reader" and outcomes["neu.txt"] == "document"
    for t in tables:
        spark.sql(f"drop table if exists q_{t}")
