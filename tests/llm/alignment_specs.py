"""Cross-tokenizer alignment of whole texts, by its definition."""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from functools import lru_cache

from inkflow.llm.token_alignment import vocabularies


@lru_cache(1)
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = vocabularies()
    a, b = Tokenizer.from_file(first), sentencepiece.SentencePieceProcessor(model_file=second)
    a.encode_special_tokens = True
    with open(first, encoding="utf-8") as f:
        own = json.load(f)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(k): k for k in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    return a, b, {i: bytes(byte[c] for c in t) for t, i in own.items()}


def groups(text: str | None) -> list[tuple[list[int], list[int]]]:
    if not text:
        return []
    a, b, of_a = libraries()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    pieces = [b.id_to_piece(i) for i in ids_b]
    bytes_a, bytes_b = [of_a[i] for i in ids_a], [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces, strict=True)]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return []
    ends = []
    for x in (bytes_a, bytes_b):
        at, own = 0, []
        for t in x:
            at += len(t)
            own.append(at)
        ends.append(own)
    both, out, p, q = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
    for end in both:
        r, s = ends[0].index(end, p) + 1, ends[1].index(end, q) + 1
        out.append((ids_a[p:r], ids_b[q:s]))
        p, q = r, s
    return out


def written(own) -> str:
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in own)


def plain(rows) -> list[tuple]:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of rows (doc_id, text)."""
    known: dict = {}
    for _, t in rows:
        if t not in known:
            known[t] = groups(t)
    counts = Counter((a[-1], b[-1]) for _, t in rows for a, b in known[t])
    best: dict[int, int] = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for i, t in rows:
        own = known[t]
        links = [(a[-1], b[-1]) for a, b in own]
        sha = hashlib.sha256(written(own).encode()).hexdigest() if own else ""
        out.append((i, sum(len(a) for a, _ in own), sum(len(b) for _, b in own), len(own), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha))
    return sorted(out, key=repr)
