"""Product codes by integer codebooks against a plain version."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from fixtures import tuples

from inkflow.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, _id long, _v string"


def plain(rows) -> list[tuple]:
    """(vec_id, code, error, label_error, codebooks_sha256); rows: (vec_id, vector, label)."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    length = max((len(v) for _, v, _ in kept), default=0)
    kept = [r for r in kept if len(r[1]) == length]
    width = length // 16
    parts = [[v[j * width : (j + 1) * width] for j in range(16)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:64]
    books = [[parts[k][j] for k in order] for j in range(16)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(2):
        for j in range(16):
            own = defaultdict(list)
            for p in parts:
                own[nearest(p[j], books[j])[1]].append(p[j])
            books[j] = [[sum(c) // len(c) for c in zip(*own[e], strict=True)] if e in own else old for e, old in enumerate(books[j])]
    found = [[nearest(p[j], books[j]) for j in range(16)] for p in parts]
    errors = [sum(d for d, _ in f) for f in found]
    labels = defaultdict(int)
    for (_, _, y), e in zip(kept, errors, strict=True):
        labels[y] += e
    sha = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), err, labels[y], sha) for (i, _, y), f, err in zip(kept, found, errors, strict=True)), key=repr)


def some(n: int, length: int = 32, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        v = [round(rng.gauss(k % 3 - 1, 0.4), rng.choice((1, 6))) for _ in range(length)]
        rows.append((rng.randrange(n), v, rng.choice((None, 0, 0, 0, 1))))
    odd = [(3, None, 1), (4, [None] + [0.5] * (length - 1), 1), (5, [float("nan")] * length, 0), (-1, [float("-inf")] + [0.0] * (length - 1), 0), (-2, [], 0), (-3, [0.25] * 16, 1), (None, [0.5] * length, None), (None, [0.5] * length, 7)]
    return rows + odd + rows[:9] + [(k, [-0.0, 1e-9, -1e-9, 999.0] * (length // 4), 2) for k in range(20)]


def query(spark, tmp_path, rows, schema=SCHEMA):
    path = str(tmp_path / "t")
    spark.createDataFrame([(*r, "x", 9, "y") for r in rows], schema).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return vector_codes.op12_vector_codes(spark, path)


@pytest.mark.parametrize("n", [150, 20])
def test_against_plain(spark, tmp_path, n):
    rows = some(n)
    assert tuples(query(spark, tmp_path, rows)) == plain(rows)


def test_equal_vectors_take_the_first_entry_and_unused_entries_stay(spark, tmp_path):
    rows = [(k, [1.0] * 16, 0) for k in range(70)]
    got = tuples(query(spark, tmp_path, rows))
    assert got == plain(rows)
    assert {r[1] for r in got} == {"00" * 16}


def test_empty_and_indivisible(spark, tmp_path):
    assert query(spark, tmp_path, []).collect() == []
    with pytest.raises(ValueError, match="17 components"):
        query(spark, tmp_path / "b", [(1, [0.0] * 17, 1)])


def test_large_components(spark, tmp_path):
    """Distances up to the bound are exact; components beyond it count as not finite."""
    top = float(vector_codes.bound(32)) / 256
    rows = [(k, [(-1) ** k * top] * 16 + [float(k)] * 16, k % 2) for k in range(6)]
    assert tuples(query(spark, tmp_path, rows)) == plain(rows)
    assert query(spark, tmp_path / "b", [*rows, (9, [2 * top] * 32, 1)]).count() == 6


def test_decoded_vectors_lie_as_far_as_the_error_says(spark):
    rows = spark.createDataFrame([r for r in some(90, 64) if r[1]], "vec_id long, embedding array<double>, label int")
    kept, books = vector_codes.fit(rows)
    decoded = vector_codes.decode(vector_codes.encode(kept, books), books).collect()
    exact = sorted(tuple(math.floor(256 * x) for x in r._v) for r in kept.collect())
    assert len(decoded) == len(exact)
    for r in decoded:
        entry = [round(256 * x) for x in r.vector]
        assert any(sum((a - b) ** 2 for a, b in zip(v, entry, strict=True)) == r.error for v in exact)
