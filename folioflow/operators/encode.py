"""Encoders: text to vectors, in Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import with_model_prefix


class Encoder(Protocol):
    """What a model must offer. An encoder is pickled to the workers and kept for a whole partition."""

    dim: int
    family: str | None

    def encode_batch(self, texts: list[str], is_query: bool = False) -> np.ndarray:
        """One unit vector per text, float32."""


class HashEncoder:
    """Counts of tokens by bucket of their MD5, scaled to length one; a text without tokens is zero."""

    family = None

    def __init__(self, dim: int = 64):
        self.dim = dim
        self._bucket: dict[str, int] = {}

    def encode_batch(self, texts: list[str], is_query: bool = False) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float64)
        for row, text in zip(out, texts):
            at = []
            for token in re.findall(r"[^\W_]+", text.lower()):
                b = self._bucket.get(token)
                if b is None:
                    b = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % self.dim
                    if len(self._bucket) < 1 << 18:
                        self._bucket[token] = b
                at.append(b)
            row += np.bincount(at, minlength=self.dim) if at else 0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)

    def __getstate__(self):
        return {"dim": self.dim, "_bucket": {}}


class SeededEncoder:
    """A random unit vector drawn from the text's MD5: equal texts, equal vectors, for tests."""

    family = None

    def __init__(self, dim: int = 384):
        self.dim = dim

    def encode_batch(self, texts: list[str], is_query: bool = False) -> np.ndarray:
        rows = [np.random.default_rng(int.from_bytes(hashlib.md5(t.encode()).digest()[:4], "big")).standard_normal(self.dim) for t in texts]
        out = np.array(rows, np.float32).reshape(len(texts), self.dim)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def encode_column(df: DataFrame, text: str, encoder: Encoder, is_query: bool = False, into: str = "embedding", batch: int = 512) -> DataFrame:
    """``df`` with the vector of a text column; null counts as empty."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = texts.fillna("").tolist()
            yield pd.Series([row for at in range(0, len(values), batch) for row in encoder.encode_batch(values[at : at + batch], is_query).astype(np.float64)], dtype=object)

    return df.withColumn(into, run(with_model_prefix(F.coalesce(F.col(text), F.lit("")), encoder.family, is_query)))


def embed_index(documents: DataFrame, chunks: DataFrame, encoder: Encoder, head: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Both tables with vectors: a document's from the first characters of its raw text, a chunk's from all of it."""
    docs = encode_column(documents.withColumn("_head", F.substring(F.col("text"), 1, head)), "_head", encoder).drop("_head")
    return docs, encode_column(chunks, "chunk_text", encoder).withColumn("embedding_dim", F.lit(encoder.dim))
