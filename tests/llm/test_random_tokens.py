"""Random tokens as values of any name, and of upper-case alphabets."""

from __future__ import annotations

import random

import brute
from inkflow.llm import secrets

UPPER_HEX, UPPER_36 = "0123456789ABCDEF", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def test_values_and_upper_case(spark):
    rng = random.Random(8)
    value = "Zx9Kq2LmP0vRt7Yb3Nc8Wd5Hs1Jf4Ga6"
    hexes, alnums = (["".join(rng.choice(a) for _ in range(128)) for _ in range(20)] for a in (UPPER_HEX, UPPER_36))
    rows = [(0, f"session={value}"), (1, f"?sig={value}&x=1"), (2, f"k {value}== tail"), (3, "internationalization=of_everything_1_and_more")]
    rows += [(100 + k, t) for k, t in enumerate(hexes)] + [(200 + k, t) for k, t in enumerate(alnums)]
    found = {r.doc_id: r.spans for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert [found[k] for k in range(4)] == ["random:8:40", "random:5:37", "random:2:36", ""]
    assert all(sum(found[at + k] == "random:0:128" for k in range(20)) >= 18 for at in (100, 200))


BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def test_battery_against_plain_python(spark):
    """Spans of kind random are those of a plain version, one to eight tokens a text; rates by encoding and length."""
    rng = random.Random(3)
    plain = ["internationalization_of_everything_1", "2024-01-01T00-00-00-release-candidate", "/usr/local/lib/python3/site-packages/x", "MAX_RETRY_COUNT_LIMIT_2", "x" * 30 + "1"]
    rows, k = [], 0
    for alphabet in (UPPER_HEX, UPPER_36, UPPER_36.lower(), BASE64):
        for size in (20, 24, 32, 48, 64, 128):
            for n in (1, 1, 3, 8):
                tokens = ["".join(rng.choice(alphabet) for _ in range(size)) if rng.random() < 0.7 else rng.choice(plain) for _ in range(n)]
                rows.append((k, " and ".join(tokens) + rng.choice(["", "\n", " é=="])))
                k += 1
    found = {r.doc_id: r.spans for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert found == {i: brute.all_spans(t) for i, t in rows}
    assert all(brute.random_secrets(" ".join(plain[j:] + plain[:j])) == [] for j in range(len(plain)))


def test_recall_of_planted_tokens():
    """Lone random tokens by encoding and length: nine in ten are found from these lengths on."""
    rng = random.Random(5)
    for alphabet, size in ((BASE64, 24), (UPPER_36, 64), (UPPER_36.lower(), 64), (UPPER_HEX, 48)):
        found = sum(bool(brute.random_secrets("".join(rng.choice(alphabet) for _ in range(size)))) for _ in range(300))
        assert found >= 270, (alphabet, size, found)
