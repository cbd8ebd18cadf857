"""The inverted index holds the places of each row's terms, without a shuffle of them."""

from __future__ import annotations

from inkflow.operators import index


def _want(rows):
    out = {}
    for k, lex in rows:
        for i, w in enumerate(lex or []):
            out.setdefault((w, k), []).append(i)
    return {x: sorted(p) for x, p in out.items()}


def test_places(spark, monkeypatch):
    monkeypatch.setattr(index, "PLACED", 3)
    rows = [(i, [f"w{(i * j) % 5}" for j in range(i % 9)] if i % 6 else None) for i in range(40)] + [(None, ["a"]), (99, ["b", None, "b", None])]
    for own, shuffled in ((rows, False), ([*rows, (99, ["b", "c"]), (7, ["w0"])], True)):
        found = index.inverted_index(spark.createDataFrame(own, "id long, content_lex array<string>").repartition(2).localCheckpoint())
        got = [((r.term, r.id), list(r.positions), r.tf) for r in found.collect()]
        assert {x: p for x, p, _ in got} == _want(own) and len(got) == len(_want(own)) and all(n == len(p) for _, p, n in got)
        assert ("Exchange" in found._jdf.queryExecution().executedPlan().toString()) == shuffled
