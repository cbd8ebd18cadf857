"""Documents with nulls, empty and long texts, ties, repeated rows and clashing column names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, _hash string, line string"


def words(rng: random.Random, n: int, of: int = 400) -> list[str]:
    return ["".join(rng.choice("abcdefghij") for _ in range(1 + k % 9)) + str(k % 7) for k in (rng.randrange(of) for _ in range(n))]


def corpus(seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    texts: list[tuple[int | None, str | None]] = [(0, None), (1, ""), (2, " \n\t \n"), (3, "one"), (4, "one two"), (None, "without an id " * 9)]
    base = [" ".join(words(rng, 90)) for _ in range(12)]
    for k in range(60):
        t = base[rng.randrange(12)]
        if k % 3 == 0:
            t = t.replace("a", "b", k % 5)
        if k % 4 == 0:
            t = t + "\n" + " ".join(words(rng, 40)) + "\n" + rng.choice(base)[:300]
        if k % 7 == 0:
            t = "\n".join([t[:80], t[80:190], t[80:190], t[:80]])
        texts.append((10 + k, t))
    texts += [(80, base[0]), (80, base[0]), (81, base[0]), (80, base[1]), (None, base[2]), (None, base[2]), (82, "x" * 5000 + " é " + "日本語 " * 300), (83, "ab" * 900), (84, "Ünï çödé \U0001f600 " * 60)]
    long = words(rng, 20_000, 100_000)
    texts += [(90, " ".join(long)), (91, "\n".join(" ".join(long[k : k + 11]) for k in range(0, 9000, 11)))]
    rng.shuffle(texts)
    return [(i, t, "en", "s", None if t is None else len(t), 7, "h", "l") for i, t in texts]


def frame(spark, rows=None, parts: int = 3):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA).repartition(parts)


def tuples(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
