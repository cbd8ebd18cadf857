"""BPE encoding and decoding by prefix-sharing trie traversal (operator 9).

The distinct words of a slice are sorted, which is the depth-first order of their trie: consecutive words share the path
of their common prefix. A path holds one state for each prefix that is asked for, the last token of its encoding; it is
the longest one that ends the prefix and that merges keep apart from the last token of what is before it. So each shared
prefix is encoded once, and a word's tokens are read back along its states. A word's final character is another symbol
(with the end mark), hence a leaf of its own.

No word and no composed character crosses a space or a line end, so a text is the sequence of its chunks between them.
Encoded words and chunks are remembered across a task's slices: up to REMEMBERED of each, and as many again that were used
before those; older ones are forgotten, so common ones stay, and all are at the end of the task, for an idle worker
keeps its memory. Ids are decoded from nothing but themselves: they index a table of token bytes, gathered by numpy. Texts
are processed where they are read: nothing is shuffled.

Defined results: null and empty texts have no tokens and decode to an empty string; the strings of special tokens in a
text are special tokens, as the file says; very long words and texts are encoded whole; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Words and chunks that a task remembers (and twice as many pairs of tokens); a slice has REMEMBERED_BYTES of text for each.
REMEMBERED = 150_000
REMEMBERED_BYTES = 20
#: Longer words have the states of all their prefixes filled in from the front rather than as they are asked for.
DEEP = 200


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class Memory(dict):
    """A dict of bounded size: `room` makes space for new keys, and keys in use come back from what was set aside."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.before = most, {}

    def forget(self) -> None:
        self.clear()
        self.before = {}

    def room(self, wanted: set[str]) -> set[str]:
        """The wanted keys that are not known; all others of them are in the dict afterwards."""
        if len(self) > self.most:
            self.before = dict(self)
            self.clear()
        missing = wanted - self.keys()
        again = missing & self.before.keys()
        self.update((k, self.before[k]) for k in again)
        return missing - again


class WordBpe:
    """A tokenizer file of a word BPE: NFC, lower case, a splitting pattern, byte symbols and an end mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.ids.items()}
        self.end = model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.specials.items()})
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(pattern)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        table = _byte_symbols()
        self.symbols = {b: table[b] for b in range(256)}
        self.pairs: dict[tuple[str, str], bool] = {}
        reachable = [t for t in self.ids if self.merged(self.split(t)) == [t]]
        self.inner = {t for t in reachable if not t.endswith(self.end)}
        self.final = {t[: -len(self.end)] for t in reachable if t.endswith(self.end)}
        self.longest = max(map(len, self.ids), default=1)
        self.memo, self.chunks = Memory(REMEMBERED), Memory(REMEMBERED)
        # each id's token and a space, one after another
        strings = [(self.tokens.get(i, "") + " ").encode() for i in range(max(self.tokens, default=-1) + 1)]
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)
        self.places = np.append(0, np.cumsum([len(x) for x in strings])).astype(np.int64)

    def decoded(self, ids: list[bytes]) -> Iterator[bytes]:
        """The text of each sequence of ids: its tokens, joined by a space."""
        flat = np.frombuffer(b"".join(ids), "<u4")
        ends = np.cumsum([len(x) // 4 for x in ids])
        starts = self.places[flat]
        buf, off = C.gather(self.bytes, starts, self.places[flat + 1])
        view, at = memoryview(buf), 0
        for end in ends.tolist():
            to = int(off[end])
            yield bytes(view[at : max(at, to - 1)])
            at = to

    def split(self, token: str) -> list[str]:
        """A token's symbols."""
        if token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def merged(self, symbols: list[str]) -> list[str]:
        """The encoding by its definition: the pair of the least rank is merged first, leftmost first."""
        symbols = list(symbols)
        while len(symbols) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == 1 << 60:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def apart(self, left: str, right: str) -> bool:
        """Whether the encoding of left + right is these two tokens."""
        pair = (left, right)
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) > 2 * self.memo.most:
                self.pairs.clear()
            known = self.pairs[pair] = self.merged(self.split(left) + self.split(right)) == [left, right]
        return known

    def _last(self, text: str, end: int, path: list, known: set[str], mark: str) -> tuple[str, int]:
        """The last token of text[:end] and where it starts. path[k]: the same of text[:k], None until it is asked for."""
        for start in range(max(0, end - self.longest), end):
            piece = text[start:end]
            if piece in known:
                token = piece + mark
                if not start or self.apart(self._state(text, start, path)[0], token):
                    return token, start
        raise ValueError(f"no token ends {text[:end]!r}")

    def _state(self, text: str, end: int, path: list) -> tuple[str, int]:
        if path[end] is None:
            path[end] = self._last(text, end, path, self.inner, "")
        return path[end]

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """(word, tokens) of distinct non-empty words given as byte symbols, along the trie of their prefixes."""
        path: list[tuple[str, int] | None] = [("", 0)]
        before = ""
        for word in sorted(words):
            shared, most = 0, min(len(path) - 1, len(word) - 1)
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del path[shared + 1 :]
            path += [None] * (len(word) - 1 - shared)
            if len(word) > DEEP:
                for end in range(1, len(word)):
                    self._state(word, end, path)
            token, start = self._last(word, len(word), path, self.final, self.end)
            out = [token]
            while start:
                token, start = self._state(word, start, path)
                out.append(token)
            before = word
            yield word, out[::-1]

    def normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def pieces(self, text: str) -> list[str]:
        """The words and special tokens of a text in order; a special token is marked by a leading NUL."""
        if self.special is None or "<" not in text or not self.special.search(text):
            return self.words.findall(self.normal(text))
        out = []
        for k, part in enumerate(self.special.split(text)):
            if k % 2:
                out.append("\0" + part)
            elif part:
                out += self.words.findall(self.normal(part))
        return out

    def learn(self, pieces: set[str]) -> None:
        """Remember the ids of each piece, as bytes."""
        todo: dict[str, str] = {}
        for p in self.memo.room(pieces):
            if p[0] == "\0" and p[1:] in self.specials:
                self.memo[p] = self.specials[p[1:]].to_bytes(4, "little")
            else:
                todo[p if p.isascii() and p.isalnum() else p.encode().decode("latin-1").translate(self.symbols)] = p
        for word, tokens in self.encode_words(list(todo)):
            self.memo[todo[word]] = b"".join([self.ids[t].to_bytes(4, "little") for t in tokens])

    def learn_chunks(self, chunks: set[str]) -> None:
        """Remember the same of each chunk; a chunk may have no token."""
        cut = {x: self.pieces(x) for x in self.chunks.room(chunks)}
        self.learn(set().union(*cut.values()))
        for x, pieces in cut.items():
            self.chunks[x] = b"".join([self.memo[p] for p in pieces])


@lru_cache(2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str, remembered: int) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """The ids of documents and of their tokens, slice by slice."""
    bpe = load(path)
    bpe.memo.most = bpe.chunks.most = remembered
    try:
        for batch in C.slices(batches, limit=remembered * REMEMBERED_BYTES):
            texts = [x.replace("\n", " ").split(" ") for x in batch.column("_text").to_pylist()]
            bpe.learn_chunks(set().union(*texts))
            get = bpe.chunks.__getitem__
            yield batch.column("_id"), [b"".join(map(get, chunks)) for chunks in texts]
    finally:
        bpe.memo.forget()
        bpe.chunks.forget()


def _encoded(batches: Iterator[pa.RecordBatch], path: str, remembered: int) -> Iterator[pa.RecordBatch]:
    for own, ids in _encode(batches, path, remembered):
        counts, texts = [len(x) // 4 for x in ids], pa.array(load(path).decoded(ids), pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([own, pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), texts], ["_id", "n_tokens", "ids", "decoded"])


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in C.slices(batches, "ids"):
        out = load(path).decoded([x or b"" for x in batch.column("ids").to_pylist()])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary()).cast(pa.string())], [*batch.schema.names, "decoded"])


def encode(docs: DataFrame, path: str, remembered: int = REMEMBERED) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, ids (little-endian unsigned 32-bit), and what they decode to."""
    out = C.texts(docs).mapInArrow(lambda it: _encoded(it, path, remembered), "_id long, n_tokens long, ids binary, decoded string")
    return out.select(C.original_id(), "n_tokens", "ids", "decoded")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded from doc_id and ids alone."""
    rows = encoded.select(F.coalesce(F.col("doc_id"), F.lit(C.NO_ID)).alias("_id"), "ids")
    return rows.mapInArrow(lambda it: _decode(it, path), "_id long, ids binary, decoded string").select(C.original_id(), "ids", "decoded")


def _digests(batches: Iterator[pa.RecordBatch], path: str, remembered: int) -> Iterator[pa.RecordBatch]:
    for own, ids in _encode(batches, path, remembered):
        counts = [len(x) // 4 for x in ids]
        columns = [[hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(x).hexdigest() for x in load(path).decoded(ids)]]
        yield pa.RecordBatch.from_arrays([own, pa.array(counts, pa.int64()), *map(pa.array, columns)], ["_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_digests(docs: DataFrame, path: str, remembered: int = REMEMBERED) -> DataFrame:
    """As encode, with the digests of ids and decoded instead of both, so that they never leave their task."""
    out = C.texts(docs).mapInArrow(lambda it: _digests(it, path, remembered), "_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.select(C.original_id(), "n_tokens", "ids_sha256", "decoded_sha256")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
