"""Stems of lists with nulls, and of a million places without an object for each."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa

from inkflow.functions import lexical, spanish


def test_nulls_and_slices():
    rows = [["casas", None, "perros"], None, [], ["casas"], ["comiendo", "casas"]]
    own = pa.array([["x"], *rows], pa.list_(pa.string()))
    want = [None if r is None else [None if w is None else spanish.stem(w) for w in r] for r in rows]
    assert [x for a in lexical._stems(iter([own.slice(1, 3), own.slice(4), own.slice(0, 0)]), "full") for x in a.to_pylist()] == want


def test_memory():
    own = pa.array([[f"palabra{i % 500}" for i in range(1000)]] * 1000, pa.list_(pa.string()))
    tracemalloc.start()
    try:
        assert sum(len(a) for a in lexical._stems(iter([own]), "full")) == 1000
        assert tracemalloc.get_traced_memory()[1] < 1_000_000
    finally:
        tracemalloc.stop()
