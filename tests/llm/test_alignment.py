"""Cross-tokenizer alignment against whole texts encoded by the libraries."""

from __future__ import annotations

import alignment_specs as specs
import numpy as np
import pytest
from fixtures import corpus, frame, tuples

from inkflow.llm import token_alignment

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    " a", "a ", "a  ", " ", "  ", "\n", "a\n b", "a\n\n  b c", "a  b", "a\x1c b", "a  b", "a b   c", "　 x", "<|endoftext|> <s> </s> <unk> <0x41>", "  x   y  ", "é\U0001f600 日本 語\t \n z", "x" * 3000, "don't we'll I'M", "12 345 6,7.8",
    "a▁b", "▁", "\x00 \x00", "\r\n \r\n", "//  code;\n    if (x) {\n\t\treturn  y; }", "é ́", "‍   x", "﻿ a",
]
ROWS = [r[:2] for r in corpus()] + [(200 + k, t) for k, t in enumerate(ODD)] + [(200, "again"), (None, None), (None, ODD[3])]


@pytest.fixture(scope="module")
def pair():
    return token_alignment.load(*token_alignment.vocabularies())


def test_segments_are_aligned_as_in_their_texts(pair):
    for _, t in ROWS:
        if t and token_alignment.MARK not in t:
            segments = [" " + x for x in token_alignment.segments_of(t)]
            assert "".join(segments) == " " + t
            tokens, sizes = pair.align(segments)
            assert sizes.sum() == len(tokens) and len(sizes) == len(segments)
            assert pair.text(tokens)[0].tobytes()[:-1].decode() == specs.written(specs.groups(t))


def test_packed_numbers():
    rng = np.random.default_rng(1)
    numbers = np.concatenate([rng.integers(0, 1 << k, 50) for k in (1, 7, 8, 14, 15, 21, 28, 35)] + [np.array([0, 127, 128, (1 << 35) - 1])])
    data, ends = token_alignment.packed(numbers)
    assert (token_alignment.unpacked(data.tobytes()) == numbers).all() and ends[-1] == len(data)
    assert len(token_alignment.unpacked(b"")) == 0


@pytest.mark.parametrize("pairs", [0, 1_000_000])
@pytest.mark.parametrize("limit", [2_000, 1 << 24])
def test_against_whole_texts(spark, pairs, limit):
    """With small and large slices, and counts of pairs joined and broadcast."""
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in ROWS], "doc_id long, text string, local long, segment string, slice string").repartition(3)
    got = token_alignment.align(docs, *token_alignment.vocabularies(), digests=True, pairs=pairs, limit=limit)
    assert tuples(got.select(*COLUMNS)) == specs.plain(ROWS)


def test_groups_are_written_out(spark):
    got = token_alignment.align(frame(spark), *token_alignment.vocabularies())
    want = sorted(((i, specs.written(specs.groups(t))) for i, t in (r[:2] for r in corpus())), key=repr)
    assert tuples(got.select("doc_id", "groups")) == want


def test_documents_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert tuples(token_alignment.op11_token_alignment(spark, sf).select(*COLUMNS)) == specs.plain(rows)


def test_without_rows_or_tokens(spark):
    names = token_alignment.vocabularies()
    assert token_alignment.align(frame(spark, []), *names, digests=True).collect() == []
    empty = spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string")
    assert tuples(token_alignment.align(empty, *names, digests=True)) == [(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2, 3)]


def test_vocabularies_that_could_cross_are_refused(tmp_path):
    import json

    first, second = token_alignment.vocabularies()
    with open(first, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["vocab"]["ofĠthe"] = 50257
    own = tmp_path / "own.json"
    own.write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="across"):
        token_alignment.Pair(str(own), second)
