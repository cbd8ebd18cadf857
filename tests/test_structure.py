"""Runs of lines are found in the row: against loops over lines, and without a shuffle."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from inkflow.operators import chunking, structure

LINES = ["# A", "## B ##", "text", "", "| a | b |", "|c|d|", "- x", "1. y", "  # no", "* z", "a | b | c", "###### deep", "#", "-"]


def texts(n: int = 80) -> list[tuple[int, str | None]]:
    rng = random.Random(8)
    return [(k, "\n".join(rng.choice(LINES) for _ in range(rng.randrange(0, 14)))) for k in range(n)] + [(500, None), (501, ""), (502, "\n"), (503, "| a | b |"), (504, "# A\n| a | b |"), (504, "- x\n- y")]


def runs(flags: list[bool]) -> list[tuple[int, int]]:
    out = []
    for i, f in enumerate(flags):
        if f and (i == 0 or not flags[i - 1]):
            out.append((i, i))
        elif f:
            out[-1] = (out[-1][0], i)
    return out


def test_runs(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "id int, text string").repartition(3)
    bars, items = [], []
    for k, t in rows:
        lines = (t or "").split("\n")
        bars += [(k, a, b, b - a + 1) for a, b in runs([x.count("|") >= 2 for x in lines])]
        listed = [bool(re.match(r"^(?:[*\-+]|\d+\.)\s+", x.strip())) for x in lines]
        items += [(k, a, b, "unordered" if lines[a].strip()[0] in "*-+" else "ordered") for a, b in runs(listed)]
    got = structure.table_runs(df, "id", last_line=True)
    assert sorted(tuple(r) for r in got.collect()) == sorted(bars)
    assert sorted(tuple(r) for r in structure.list_runs(df, "id").collect()) == sorted(items)


def test_nothing_is_shuffled(spark):
    df = spark.createDataFrame(texts(), "id int, text string")
    for op in (structure.table_runs, structure.list_runs, structure.section_ranges, structure.sections, structure.headings, structure.structure, chunking.semantic_chunks):
        assert "Exchange" not in op(df, "id")._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_key_stay_apart(spark):
    df = spark.createDataFrame([(1, "# A\nx"), (1, "# B\ny")], "id int, text string")
    got = structure.sections(df, "id").select("id", "ordinal", "heading", "content").collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, "A", "# A\nx"), (1, 0, "B", "# B\ny")]
    assert structure.sections(df.filter(F.lit(False)), "id").count() == 0
