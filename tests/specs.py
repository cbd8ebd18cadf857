"""Independent definitions of the order-dependent operators, as plain loops."""

from __future__ import annotations

import re


def toks(text: str) -> list[str]:
    return re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", text)


def n(text: str) -> int:
    return len(toks(text))


def tail(text: str, k: int) -> str:
    own = toks(text)
    return text if len(own) <= k else "".join(own[len(own) - k :])


def windows(text: str, size: int, overlap: int) -> list[str]:
    own = toks(text)
    if len(own) <= size:
        return [text]
    return ["".join(own[a : a + size]) for a in range(0, len(own), size - overlap)]


def pack(parts: list[str], sep: str, most: int, overlap: int, split) -> list[str]:
    done: list[str] = []
    current: list[str] = []
    used = 0
    for part in parts:
        size = n(part)
        if size > most:
            if current:
                done.append(sep.join(current))
            current, used = [], 0
            done += split(part)
        elif current and used + size > most:
            done.append(sep.join(current))
            carried = tail(done[-1], overlap) if overlap else ""
            current = [carried, part] if carried else [part]
            used = n(sep.join(current)) if carried else size
        else:
            current.append(part)
            used += size
    return done + [sep.join(current)] * bool(current)


def sentences(text: str, most: int, overlap: int) -> list[str]:
    parts = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]
    return pack(parts, " ", most, overlap, lambda s: windows(s, most, overlap)) or [text]


def blocks(text: str) -> list[str]:
    """A mark opens a table and closes what was open; a blank line after three lines closes a table."""
    done, current, table = [], [], False
    for line in text.split("\n"):
        if re.match(r"\[Tabla\s+\d+\]", line, re.I):
            if current:
                done.append("\n".join(current))
            current, table = [line], True
        else:
            current.append(line)
            if table and not line.strip() and len(current) > 3:
                done.append("\n".join(current))
                current, table = [], False
    return done + ["\n".join(current)] * bool(current)


def paragraphs(text: str, most: int, overlap: int) -> list[str]:
    if not text.strip():
        return []
    found = re.search(r"^\[Tabla\s+\d+\]", text, re.I | re.M)
    parts = [p.strip() for p in (blocks(text) if found else re.split(r"\n\s*\n", text)) if p.strip()]
    return pack(parts, "\n\n", most, overlap, lambda p: sentences(p, most, overlap)) or [text]


def sections(text: str) -> list[dict]:
    out: list[dict] = []
    for line in text.split("\n"):
        m = re.match(r"^(#{1,6})\s+(.+)$", line)
        if m:
            out.append({"type": "heading", "content": [line], "level": len(m[1]), "heading": m[2]})
        elif line.count("|") >= 2 and (not out or out[-1]["type"] != "table"):
            out.append({"type": "table", "content": [line], "level": 0, "heading": ""})
        elif not out:
            out.append({"type": "text", "content": [line], "level": 0, "heading": ""})
        else:
            out[-1]["content"].append(line)
    return [s | {"content": "\n".join(s["content"])} for s in out]


def section_chunks(text: str, most: int, overlap: int, tables: bool = True) -> list[tuple]:
    def chunk(parts):
        content = "\n\n".join(p["content"] for p in parts)
        return (content, n(content), next((p["heading"] for p in parts if p["heading"]), ""), len(parts), any(p["type"] == "table" for p in parts), any(p["type"] == "heading" for p in parts))

    done, current, used = [], [], 0
    for s in sections(text):
        size = n(s["content"])
        if current and used + size > most:
            done.append(chunk(current))
            if s["type"] == "table" and tables:
                current, used = [s], size
            else:
                last = current[-1]
                over = last if n(last["content"]) <= overlap else {"type": "text", "content": tail(last["content"], overlap), "heading": ""}
                current = [over, s]
                used = n("\n\n".join(p["content"] for p in current))
        else:
            current.append(s)
            used += size
    return done + [chunk(current)] * bool(current)


def embedding_pieces(text: str, most: int) -> list[str]:
    def fold(parts, sep, end):
        done, current, used = [], [], 0
        for p in parts:
            if current and used + n(p) > most:
                done.append(sep.join(current) + end)
                current, used = [p], n(p)
            else:
                current.append(p)
                used += n(p)
        return done + [sep.join(current)]

    if n(text) <= most:
        return [text]
    return [x for piece in fold(text.split(". "), ". ", ".") for x in ([piece] if n(piece) <= most else fold(piece.split("\n\n"), "\n\n", ""))]


def inject(text: str, captions: list[tuple[int | None, str]]) -> str:
    """captions: (page, caption) in order."""
    if not captions:
        return text
    by_page: dict[int, list[str]] = {}
    for page, caption in captions:
        by_page.setdefault(1 if page is None else page, []).append(caption)
    lines, page, marks = text.split("\n"), 1, []
    for line in lines:
        p, s = re.search(r"[Pp]ágina\s+(\d+)", line), re.search(r"punto\s+(\d+(?:\.\d+)?)", line, re.I)
        page = int(p[1]) if p else page
        marks.append((page, s[1] if s else None))
    pages_of: dict[str, list[int]] = {}
    for page, s in marks:
        if s:
            pages_of.setdefault(s, []).append(page)
    with_sections = {page for page, s in marks if s}
    out, done = [], set()
    for line, (page, s) in zip(lines, marks, strict=True):
        out.append(line)
        if s:
            for p in [*pages_of[s], page, page + 1, page - 1]:
                if p in by_page and p not in done:
                    out += [f"\n[Contenido de la página {p} - PUNTO {s}]: {c}\n" for c in by_page[p]]
                    done.add(p)
        if page in by_page and page not in done:
            if page not in with_sections:
                out += [f"\n[Contenido visual de la página {page}]: {c}\n" for c in by_page[page]]
            done.add(page)
    out += [f"\n[Contenido visual de la página {p}]: {c}\n" for p, cs in by_page.items() if p not in done for c in cs]
    return "\n".join(out)


def contains(hay, needle) -> bool:
    if isinstance(needle, dict):
        return isinstance(hay, dict) and all(k in hay and contains(hay[k], v) for k, v in needle.items())
    if isinstance(needle, list):
        return isinstance(hay, list) and all(any(contains(x, v) for x in hay) for v in needle)
    if isinstance(needle, bool) or isinstance(hay, bool) or needle is None:
        return type(hay) is type(needle) and hay == needle
    if isinstance(needle, int | float):
        return isinstance(hay, int | float) and hay == needle
    return isinstance(hay, str) and hay == needle


def ranking(response: str, k: int) -> list[int]:
    own = list(dict.fromkeys(int(x) for x in re.findall(r"\d+", response) if int(x) < k))
    return own + [i for i in range(k) if i not in own]
