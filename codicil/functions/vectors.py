"""Similarity of vectors, and a deterministic embedder."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 1024


class EmbeddingDimensionError(ValueError):
    """A model gave vectors of another length than the table holds."""


class Embedder(Protocol):
    model: str

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


def checked(vectors: list[list[float]], texts: Sequence[str], dimensions: int = DIMENSIONS) -> list[list[float]]:
    if len(vectors) != len(texts):
        raise ValueError(f"{len(texts)} texts gave {len(vectors)} vectors")
    for v in vectors:
        if len(v) != dimensions:
            raise EmbeddingDimensionError(f"expected {dimensions} dimensions, got {len(v)}")
    return vectors


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in plain expressions; 0 where a norm is 0."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce(p, F.lit(0.0)) * F.coalesce(q, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def matrix(vectors: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix of doubles."""
    flat = np.asarray(vectors.flatten(), np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))


def cosines(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """All cosines (rows by queries) in one product; 0 where a norm is 0."""
    norms = np.linalg.norm(vectors, axis=1)[:, None] * np.linalg.norm(queries, axis=1)[None, :]
    dots = vectors @ queries.T
    return np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)


def similarity_to(vectors: Column, query: Sequence[float]) -> Column:
    """Cosine similarity of a column with one vector: a matrix product for each Arrow batch."""
    q = np.asarray(query, np.float64)[None, :]

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        out = np.full(len(column), np.nan)
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        if valid.any():
            out[valid] = cosines(matrix(column.drop_null()), q)[:, 0]
        return pa.array(out, pa.float64(), mask=~valid)

    return run(vectors)


_WORDS = re.compile("[a-z0-9]+")


def hashed_vector(text: str, dimensions: int = DIMENSIONS) -> list[float]:
    """Counts of words (without accents, lower case) at their 32-bit FNV-1a hashes, of length 1; without words the first unit vector."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower()
    v = np.zeros(dimensions)
    for word in _WORDS.findall(plain):
        h = 0x811C9DC5
        for b in word.encode():
            h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
        v[h % dimensions] += 1
    norm = float(np.sqrt((v * v).sum()))
    if norm == 0:
        v[0] = norm = 1.0
    return (v / norm).tolist()


class HashingEmbedder:
    """Stands in for a model: texts that share words are alike."""

    def __init__(self, model: str = "hashing", dimensions: int = DIMENSIONS):
        self.model, self.dimensions = model, dimensions

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return [hashed_vector(t, self.dimensions) for t in texts]


def hashed(text: Column, dimensions: int = DIMENSIONS) -> Column:
    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else hashed_vector(t, dimensions) for t in texts.to_pylist()], pa.list_(pa.float32()))

    return run(text)
