"""Plain definitions of the operators' results, to hold Spark's results against."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

NO_ID = (1 << 63) - 1
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(x: bytes | str) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def suffixes(rows, length: int) -> list[tuple]:
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[k : k + length] for _, r in raws for k in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        gone = bytearray(len(r))
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(r), sum(gone), runs, sha(bytes(b for b, g in zip(r, gone) if not g))))
    return out


def rules(text: str | None) -> tuple:
    w = words_of(text)
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    hit = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed


def substrings(rows, window: int = 13) -> list[tuple]:
    least: dict[tuple, int] = {}
    split = [(NO_ID if i is None else i, words_of(t)) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, i), i)
    out = []
    for (i, w), (raw, _) in zip(split, rows, strict=True):
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < i:
                keep[k : k + window] = [False] * window
        out.append((raw, len(w), keep.count(False), sha(" ".join(x for x, y in zip(w, keep) if y))))
    return out


def lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    w = words_of(lower(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids_and_values, radius: int = 2) -> dict[int, int]:
    """The least id of each value's component."""
    values = sorted({v for _, v in ids_and_values})
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for k, a in enumerate(values):
        for b in values[k + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least: dict[int, int] = {}
    for i, v in ids_and_values:
        least[find(v)] = min(least.get(find(v), NO_ID), NO_ID if i is None else i)
    return {v: least[find(v)] for v in values}


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN = re.compile("".join(f"[{c}{c.upper()}]" if c.islower() else c for c in "(password|passwd|secret|token|api_?key)") + ASSIGN.pattern.partition("key)")[2])


def base_secrets(text: str | None) -> list[tuple[int, int, str]]:
    t = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


ALPHABETS = {
    "[0-9a-f]+": "0123456789abcdef", "[0-9A-F]+": "0123456789ABCDEF", "[A-Z2-7]+=*": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "[0-9a-z]+": "0123456789abcdefghijklmnopqrstuvwxyz",
    "[0-9A-Z]+": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]+=*": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def log_p(token: str) -> float | None:
    """The log of the battery's p-value, None for a token of no encoding."""
    if not (re.search("[0-9]", token) and re.search("[A-Za-z]", token)):
        return None
    alphabet = next((a for p, a in ALPHABETS.items() if re.fullmatch(p, token)), None)
    if alphabet is None:
        return None
    place = [alphabet.index({"-": "+", "_": "/"}.get(c, c)) / len(alphabet) for c in re.sub("=+$", "", token)]
    n = len(place)
    chi = 8 * sum(v * v for v in Counter(int(p * 8) for p in place).values()) / n - n
    serial = abs(sum((a - 0.5) * (b - 0.5) for a, b in zip(place, place[1:], strict=False))) * 12 / math.sqrt(max(1, n - 1))
    kinds = [0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 3 for c in token]
    m = len(token) - 1
    rate = min(max(sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / m, 1e-9), 1 - 1e-9)
    root = math.sqrt(max(0, 2 * m * (rate * math.log(rate / 0.12) + (1 - rate) * math.log((1 - rate) / 0.88))))
    even = (0.5 * n + 7 - chi) / math.sqrt(14 + 2 * n)
    z = ((root if rate > 0.12 else -root) + 0.5 * even + 0.25 * (0.2 * math.sqrt(n) - serial)) / math.sqrt(1 + 0.25 + 0.0625)
    normal = ((max(chi, 0) / 7) ** (1 / 3) - (1 - 2 / 63)) / math.sqrt(2 / 63)
    return math.log(0.5) - z * z / 2 if z > 0 and normal <= 3.0902 and serial <= 3.0902 else 0.0


def random_secrets(text: str | None) -> list[tuple]:
    """Spans of kind random: the step-up over a text's tokens that touch no other span."""
    taken = base_secrets(text)
    tested = []
    for m in re.finditer("(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}=*", text or ""):
        p = log_p(m[0])
        if p is not None and not any(a < m.end() and m.start() < b for _, a, b in taken):
            tested.append((m.start(), m.end(), p))
    mean = sum(b - a for a, b, _ in tested) / max(1, len(tested))
    ordered = sorted((p - math.log((b - a) / mean), p, a, b) for a, b, p in tested)
    top = max((k for k, x in enumerate(ordered, 1) if x[0] <= math.log(1e-4 * k / len(ordered))), default=0)
    return sorted(("random", a, b) for _, p, a, b in ordered[:top] if p < 0)


def all_spans(text: str | None) -> str:
    rank = ("assign", "access", "hex", "random")
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(base_secrets(text) + random_secrets(text), key=lambda x: (x[1], rank.index(x[0]))))


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def lines(rows, edits: int = 2, least: int = 30) -> list[tuple]:
    """(id, n_exact, n_near, kept text) of each row."""
    first: dict[str, tuple] = {}
    where = []
    for i, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            if words_of(x):
                place = (NO_ID if i is None else i, k)
                where.append((x, place))
                first[x] = min(first.get(x, place), place)
    by_size = defaultdict(list)
    for x in first:
        if len(x) >= least:
            by_size[len(x)].append(x)
    near = {x for n, own in by_size.items() for x in own for m in range(n - edits, n + edits + 1) for y in by_size.get(m, ()) if first[y] < first[x] and edit_distance(x, y) <= edits}
    out = []
    for i, t in rows:
        kept, exact, close = [], 0, 0
        for k, x in enumerate((t or "").split("\n")):
            if words_of(x) and x in near:
                close += 1
            elif words_of(x) and first[x] != (NO_ID if i is None else i, k):
                exact += 1
            else:
                kept.append(x)
        out.append((i, exact, close, "\n".join(kept)))
    return out


def contaminated(docs, items) -> set[tuple]:
    """(doc, item, common, union) of the best window of each document and item at 0.8 or more."""

    def shingles(t):
        w = words_of(lower(t or ""))
        return [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []

    best: dict[tuple, tuple] = {}
    for d, t in docs:
        s = shingles(t)
        for i, u in items:
            v = shingles(u)
            if not s or not v:
                continue
            c = Counter(v)
            for at in range(max(1, len(s) - len(v) + 1)):
                w = Counter(s[at : at + len(v)])
                common = sum((w & c).values())
                union = sum(w.values()) + len(v) - common
                if common * 10 >= union * 8 and (common / union, -at) > best.get((d, i), (0, 0))[:2]:
                    best[d, i] = (common / union, -at, common, union)
    return {(d, i, x[2], x[3]) for (d, i), x in best.items()}


def kept_by_policy(text: str | None) -> bool:
    n, chars, symbols, dup, _, failed = rules(text)
    lines = sum(1 for x in (text or "").split("\n") if words_of(x))
    marks, longest = len(re.findall(r"[\x21-\x40\x5B-\x60\x7B-\x7E]", text or "")), max(map(len, words_of(text)), default=0)
    return not (failed or 10 * symbols > 3 * n or (lines >= 4 and 10 * dup > 6 * lines) or (n >= 20 and (chars < 2 * n or chars > 20 * n or 2 * marks > chars or 2 * longest > chars)))
