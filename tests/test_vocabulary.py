"""Tokens of a vocabulary against two libraries: counts, windows, tails, and packing of a context."""

from __future__ import annotations

import base64

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkflow.functions import vocabulary
from inkflow.operators import chunking, retrieval

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.tiktoken")

TEXTS = ["", " ", "hello world", "  two  spaces\n\n\tand tabs ", "don't we'll I'VE", "áéí ñandú 日本語 \U0001f600\U0001f600\U0001f600", "x" * 2000, "aaaaaaaaaaaaaaaab" * 40, "12345 67,8 9%", "　\xa0 a", "<|endoftext|>", "word " * 300, "\x00\x01 é"]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sizes(library, text):
    return [len(library.decode_single_token_bytes(i)) for i in library.encode_ordinary(text)]


@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("abc  \n'stl")), max_size=80))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    own = test_any_text.library = getattr(test_any_text, "library", None) or tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.encoder(PATH).ranks, special_tokens={})
    assert vocabulary.encoder(PATH).sizes(text) == sizes(own, text)


def test_counts_and_both_libraries(spark, library, sf):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    df = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "text string").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("text"))
    for r in df.select("text", vocabulary.count(F.col("text"), PATH).alias("n"), vocabulary.ends(F.col("text"), PATH).alias("ends")).collect():
        if r.text is None:
            assert r.ends is None
            continue
        want = sizes(library, r.text)
        assert r.n == len(want) == len(other.encode(r.text, add_special_tokens=False).ids)
        assert r.ends == [sum(want[: k + 1]) for k in range(len(want))] if len(want) < 500 else r.ends[-1] == sum(want)


@pytest.mark.parametrize(("size", "overlap"), [(7, 2), (5, 0), (1, 0), (100, 99)])
def test_windows_and_tails(spark, library, size, overlap):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got: dict[int, list[str]] = {}
    for r in chunking.fixed_windows(df, "id", size=size, overlap=overlap, vocabulary=PATH).orderBy("id", "chunk_index").collect():
        got.setdefault(r.id, []).append(r.content)
    ids = [library.encode_ordinary(t) for t in TEXTS]
    for k, own in enumerate(ids):
        want = [TEXTS[k]] if len(own) <= size else [library.decode(own[i : i + size]) for i in range(0, len(own), size - overlap)]
        assert got[k] == want
    ends = vocabulary.ends(F.col("text"), PATH)
    tails = {r.id: r.t for r in df.select("id", "text", ends.alias("e")).select("id", vocabulary.last(F.col("text"), F.col("e"), size).alias("t")).collect()}
    assert all(tails[k] == library.decode(own[-size:]) if len(own) > size else tails[k] == TEXTS[k] for k, own in enumerate(ids))


def test_context_by_a_vocabulary(spark, library):
    ranked = spark.createDataFrame([(1, k, t) for k, t in enumerate(TEXTS)], "q int, rank int, content string")
    got = retrieval.packed_context(ranked, "q", most=60, count=lambda c: vocabulary.count(c, PATH)).orderBy("rank").collect()
    counts = [len(library.encode_ordinary(t)) for t in TEXTS]
    kept = 0
    while kept < len(counts) and sum(counts[: kept + 1]) <= 60:
        kept += 1
    assert [r.tokens for r in got] == counts[:kept]


def test_short_pieces_are_merged_alike(monkeypatch):
    """By a list of ranks or by a heap; and pieces come back from those remembered before."""
    ranks, texts = vocabulary.encoder(PATH).ranks, ["unbelievableness", "aaaaaaaaaaaaaa", "señoríos", "x", "0x7f3a9cbb", "ththandanere"]
    short = [vocabulary.merged(t.encode(), ranks) for t in texts]
    monkeypatch.setattr(vocabulary, "SHORT", 0)
    assert short == [vocabulary.merged(t.encode(), ranks) for t in texts]
    monkeypatch.setattr(vocabulary, "REMEMBERED", 2)
    own = vocabulary.Encoder(PATH, vocabulary.PATTERN)
    for t in texts * 2:
        assert own.sizes(t) == vocabulary.encoder(PATH).sizes(t) and own.ends(t).tolist() == np.cumsum(own.sizes(t)).tolist()


def test_windows_of_a_long_text_take_no_square_of_its_length(spark):
    """Each of the 30,000 windows of 3 MB encoded the text anew before, 90 GB in all."""
    text, stops = F.repeat(F.lit("abc "), 750_000), F.sequence(F.lit(4), F.lit(3_000_000), F.lit(4))
    own = spark.range(1).select(text.alias("t"), stops.alias("s"))
    starts = F.sequence(F.lit(0), F.size("s") - 1, F.lit(25))
    got = own.select(F.size(vocabulary.cuts(F.col("t"), F.col("s"), starts, 25)).alias("n"), F.length(F.array_join(vocabulary.windows(F.col("t"), F.col("s"), 25, 0), "")).alias("k")).first()
    assert (got.n, got.k) == (30_000, 3_000_000)
