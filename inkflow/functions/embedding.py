"""Embeddings of texts by a replaceable model, in batches; a hashing model stands in where there is none."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkflow.config import DEFAULTS


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A reproducible model: each word adds a signed unit to one dimension; vectors have length one."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % dim] += 1 if h >> 63 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size == 0, 1, size)).tolist()

    return embed


def embedded(text: Column, model: Callable[[list[str]], list[list[float]]], batch: int = DEFAULTS.embedding_batch) -> Column:
    """A text's vector; the model gets at most `batch` texts at a time."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            own = [t or "" for t in texts]
            yield pd.Series([v for k in range(0, len(own), batch) for v in model(own[k : k + batch])])

    return run(text)
