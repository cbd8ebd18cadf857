from __future__ import annotations

import numpy as np
import pytest
from fixtures import corpus, frame

import brute
import corpus_pipeline
from inkflow.llm import bpe


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    frame(spark).write.parquet(f"{folder}/documents.parquet")
    texts = [r[1] for r in corpus() if r[1] and 300 < len(r[1]) < 2000]
    items = [(0, " ".join(texts[0].split()[5:45])), (1, texts[3][:200].upper()), (2, "nowhere to be found in any text at all"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def test_run(spark, tables):
    from tokenizers import Tokenizer

    folder, items = tables
    rows = [r[:2] for r in corpus() if brute.kept_by_policy(r[1])]
    rows = [(i, None if t is None else kept) for (i, t), (_, _, _, kept) in zip(rows, brute.lines(rows), strict=True)]
    values = [(i, brute.fingerprint(t, corpus_pipeline.SHINGLE)) for i, t in rows]
    least = brute.components(values, corpus_pipeline.RADIUS)
    first = {brute.NO_ID if i is None else i for (i, v) in values if least[v] == (brute.NO_ID if i is None else i)}
    one: dict = {}
    for i, t in rows:
        if (brute.NO_ID if i is None else i) in first:
            one.setdefault(i, set()).add(t)
    assert all(len(texts) == 1 for texts in one.values())
    kept = [(i, next(iter(texts))) for i, texts in one.items()]
    gone = {d for d, *_ in brute.contaminated(kept, items)}
    assert gone
    tok = Tokenizer.from_file(bpe.vocabulary())
    tok.no_truncation()
    want = []
    for i, t in kept:
        if i not in gone:
            ids = tok.encode(t or "", add_special_tokens=False).ids
            want.append((i, len(ids), np.array(ids, "<u4").tobytes(), brute.sha(tok.decode(ids, skip_special_tokens=False))))
    got = [(r.doc_id, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(want) > 5


def test_stages(spark, tables):
    folder, _ = tables
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "bpe"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert name == "bpe" or out.dtypes == docs.dtypes
        empty = stage(spark, docs.limit(0), folder)
        assert empty.collect() == [] and empty.columns == out.columns


def test_recall_of_near_dedup():
    """Of near copies at 0.95 of their five-word shingles most lie within the radius, at 0.8 few do; unrelated texts don't."""
    rng = np.random.default_rng(7)
    caught = {}
    for share in (0.8, 0.9, 0.95):
        near = []
        for _ in range(150):
            w = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
            n = round(396 * (1 - share) / (1 + share))  # shingles that differ on either side
            v = w[:-n] + [f"x{x}" for x in rng.integers(0, 10**6, n)]
            a, b = (brute.fingerprint(" ".join(t), corpus_pipeline.SHINGLE) for t in (w, v))
            near.append((a ^ b).bit_count() <= corpus_pipeline.RADIUS)
        caught[share] = np.mean(near)
    assert caught[0.8] < 0.4 and caught[0.9] > 0.35 and caught[0.95] > 0.7, caught
