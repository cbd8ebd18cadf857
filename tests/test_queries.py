"""Every query with SQL gives DuckDB's rows on the smallest tables; the neighbour graph's on larger ones, as with few vectors it
scores a larger share of them."""

from __future__ import annotations

import duckdb
import pytest

from inkflow.plans import catalogue, indexed, ingested, lexemes, records  # noqa: F401  these add their queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


ON_LARGER = {"vec_graph_topk": "/root/testdata/sf0.01", "vec_graph_cost": "/root/testdata/sf0.01"}


@pytest.fixture(scope="module")
def duck():
    def on(folder: str):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
        return con

    return on


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    folder = ON_LARGER.get(name, sf)
    df = catalogue.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got
    if name in catalogue.SQL:
        found = duck(folder).execute(catalogue.SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert got == sorted((tuple(x[names.index(c)] for c in columns) for x in found.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
