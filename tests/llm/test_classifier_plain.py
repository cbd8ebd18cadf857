"""The classifier's statistics, splits and scores against plain versions of them."""

from __future__ import annotations

import math
from collections import Counter
from statistics import fmean, pstdev

import numpy as np
import pyarrow as pa
import pytest
from fixtures import corpus

from inkflow.llm import quality_classifier as Q


def plain_statistics(text: str | None) -> list[float]:
    raw = (text or "").encode()
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    grams = list(zip(words, words[1:], words[2:], strict=False))
    long = [len(w) for w in words]
    letter = [65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)]

    def share(n: int, of: int) -> float:
        return n / of if of else 0.0

    def bytes_in(chars: str) -> float:
        return share(sum(raw.count(c.encode()) for c in chars), len(raw))

    out = {
        "bytes": math.log1p(len(raw)), "words": math.log1p(len(words)), "lines": math.log1p(len(lines)), "word_length": fmean(long) if long else 0, "word_length_sd": pstdev(long) if long else 0,
        "longest_word": math.log1p(max(long, default=0)), "distinct_words": 1 - share(len(words) - len(set(words)), len(words)), "repeated_trigrams": share(len(grams) - len(set(grams)), len(grams)),
        "commonest_word": share(max(Counter(words).values(), default=0), len(words)), "short_words": share(sum(x <= 2 for x in long), len(words)), "long_words": share(sum(x >= 14 for x in long), len(words)),
        "letters": share(sum(letter[b] for b in raw), len(raw)), "upper": bytes_in("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": bytes_in("0123456789"), "symbols": bytes_in("#*$%&<>@^~_=+\\"), "pipes": bytes_in("|"),
        "sentence_marks": bytes_in(".!?"), "commas": bytes_in(",;:"), "other_marks": bytes_in("()[]{}\"'/-`"), "non_ascii": share(sum(b >= 128 for b in raw), len(raw)), "white_space": bytes_in(" \t\n\v\f\r"),
        "line_length": math.log1p(fmean(map(len, lines)) if lines else 0), "repeated_lines": share(len(lines) - len(set(lines)), len(lines)), "short_lines": share(sum(len(x) < 30 for x in lines), len(lines)),
        "capital_words": share(sum(65 <= w[0] <= 90 for w in words), len(words)), "non_letter_words": share(sum(not letter[w[0]] for w in words), len(words)),
    }
    return [out[k] for k in Q.STATISTICS]


def same(texts: list[str | None]) -> None:
    got = Q.statistics(pa.array([t or "" for t in texts], pa.string()))
    for t, row in zip(texts, got, strict=True):
        want = plain_statistics(t)
        off = [(k, a, b) for k, a, b in zip(Q.STATISTICS, row.tolist(), want, strict=True) if not math.isclose(a, b, rel_tol=1e-4, abs_tol=1e-3)]
        assert not off, (off, (t or "")[:80])


def test_statistics_of_odd_texts():
    same([None, "", "\n", "\n\n a\n", "a", " \t\r\n\v\f", "é ñ Ünï\U0001f600", "x" * 60_000, "one two three one two three one", "a|b|c\n" * 500, "Same Line.\nSame Line.\nother", "\na", "a\n", *(r[1] for r in corpus())])


def test_statistics_of_documents(spark, sf):
    same([r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()])


def walked(forest: Q.Forest, row: np.ndarray) -> float:
    total = forest.base
    for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
        total += leaf[node - len(feature)]
    return 1 / (1 + math.exp(-total))


def plain_margins(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rate: float, bins: int, ridge: float, least: float) -> np.ndarray:
    """The margins of the rows that trees are grown on, each split by trying all borders of all columns on the node's rows."""
    margin = np.full(len(y), math.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    edges = [sorted({float(np.float32(np.quantile(c, k / bins))) for k in range(1, bins)}) for c in x.T]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        step = np.zeros(len(y))

        def grow(rows: np.ndarray, left: int, g=g, h=h, step=step) -> None:
            if not left:
                step[rows] = rate * g[rows].sum() / (h[rows].sum() + ridge)
                return
            best, at = 1e-6, None
            for f, own in enumerate(edges):
                for e in own:
                    low = rows[x[rows, f] <= e]
                    hl, hr = h[low].sum(), h[rows].sum() - h[low].sum()
                    if hl < least or hr < least:
                        continue
                    gl, gr = g[low].sum(), g[rows].sum() - g[low].sum()
                    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (gl + gr) ** 2 / (hl + hr + ridge)
                    if gain > best + 1e-9:
                        best, at = gain, (f, e)
            if at is None:
                grow(rows, 0)
                return
            under = x[rows, at[0]] <= at[1]
            grow(rows[under], left - 1)
            grow(rows[~under], left - 1)

        grow(np.arange(len(y)), depth)
        margin = margin + step
    return margin


@pytest.mark.parametrize("seed", range(3))
def test_splits_and_scores(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(300, 4)).astype(np.float32)
    y = ((x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(size=300) * 0.3) > 0.4).astype(float)
    how = {"trees": 6, "depth": 3, "rate": 0.3, "bins": 12, "ridge": 1.0, "least": 3.0}
    forest = Q.fit(x, y, **how)
    got = forest.score(x)
    assert np.allclose(got, [walked(forest, r) for r in x], atol=1e-12)
    assert np.allclose(got, 1 / (1 + np.exp(-plain_margins(x, y, **how))), atol=1e-6)


def test_labels_of_the_held_out_fold_do_not_count(spark, sf):
    """Scores stay when the labels of held-out rows are turned round."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("quality", Q.F.when(Q.fold_of() == 0, 1 - Q.F.col("quality")).otherwise(Q.F.col("quality")))
    first, again = (sorted((r.doc_id, r.score) for r in Q.classify_quality(docs, x).collect()) for x in (labels, turned))
    assert first == again
