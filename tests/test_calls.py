"""Calls are made once for each distinct request, failures are tried again and told, refusals go to the next way."""

from __future__ import annotations

import os
import time

from inkflow.sources import calls
from inkflow.sources.providers import Unsupported


def texts(folder) -> list[str]:
    return sorted(open(os.path.join(folder, n)).read() for n in os.listdir(folder))


def test_each_request_is_asked_once(spark, tmp_path):
    log, store = tmp_path / "log", str(tmp_path / "store")
    log.mkdir()
    log = str(log)

    def model(text):
        with open(f"{log}/{os.urandom(8).hex()}", "w") as f:
            f.write(text)
        if text == "bad":
            raise ValueError("down")
        return [float(len(text)), 1.0]

    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, "bad"), (5, "a")], "id int, t string")
    got = {r.id: (r.embedding, r.error) for r in calls.embedded(rows, "t", model, store, "m1", attempts=3, pause=0.01).collect()}
    assert got[1] == got[3] == got[5] == ([1.0, 1.0], None) and got[2] == ([2.0, 1.0], None) and got[4] == (None, "ValueError: down")
    assert texts(log) == ["a", "bad", "bad", "bad", "bb"]
    # a second run asks only what failed and what is new
    more = rows.unionByName(spark.createDataFrame([(6, "ccc")], "id int, t string"))
    again = {r.id: (r.embedding, r.error) for r in calls.embedded(more, "t", model, store, "m1", attempts=1).collect()}
    assert again[6] == ([3.0, 1.0], None) and {k: v for k, v in again.items() if k < 6} == got
    assert texts(log) == sorted(["a", "bad", "bad", "bad", "bb", "bad", "ccc"])
    # another model's answers are others
    assert calls.embedded(rows.filter("id = 1"), "t", model, store, "m2").count() == 1 and texts(log).count("a") == 2


def test_ways_in_order(spark, tmp_path):
    def detection(content, kind):
        if kind == "pdf":
            raise Unsupported("several pages")
        return ["detected"]

    def analysis(content, kind):
        if content == b"x":
            raise OSError("no")
        return ["analysed", "2"]

    rows = spark.createDataFrame([(1, bytearray(b"a"), "png"), (2, bytearray(b"b"), "pdf"), (3, bytearray(b"x"), "pdf"), (4, None, "pdf")], "id int, content binary, file_type string")
    got = {r.id: (r.answer, r.error) for r in calls.read_documents(rows, [detection, analysis], str(tmp_path), "ocr", pause=0.0).collect()}
    assert got == {1: (["detected"], None), 2: (["analysed", "2"], None), 3: (None, "OSError: no"), 4: (["analysed", "2"], None)}


def test_pauses_grow_and_calls_are_open_together():
    times = []

    def fails(_):
        times.append(time.monotonic())
        raise OSError("busy")

    assert calls.tried([fails], (1,), 4, 0.02) == (None, "OSError: busy", 4)
    gaps = [b - a for a, b in zip(times, times[1:], strict=False)]
    assert gaps[0] >= 0.02 and gaps[1] >= 0.04 and gaps[2] >= 0.08


def test_no_rows(spark, tmp_path):
    rows = spark.createDataFrame([], "id int, t string")
    assert calls.embedded(rows, "t", lambda t: [1.0], str(tmp_path), "m").collect() == []
