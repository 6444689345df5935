"""Embedding and rerank providers: protocols, and deterministic ones that need no network."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.errors import SchemaError


class EmbeddingProvider(Protocol):
    """Texts to vectors; called on the workers with a batch."""

    def embed(self, texts: list[str], dim: int) -> list[list[float]]: ...


class RerankProvider(Protocol):
    """Scores of texts for a query; called on the workers with a batch."""

    def rerank(self, query: str, texts: list[str]) -> list[float]: ...


class HashEmbedding:
    """Sums of seeded vectors of the words: equal words make texts alike."""

    def embed(self, texts: list[str], dim: int) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in t.lower().split():
                v += np.random.default_rng(int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "big")).standard_normal(dim)
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


class OverlapRerank:
    """The share of the query's words that a text has."""

    def rerank(self, query: str, texts: list[str]) -> list[float]:
        q = set(query.lower().split())
        return [len(q & set(t.lower().split())) / len(q) if q else 0.0 for t in texts]


EMBEDDINGS: dict[str, Callable[[dict], EmbeddingProvider]] = {"hash": lambda _: HashEmbedding()}
RERANKERS: dict[str, Callable[[dict], RerankProvider]] = {"overlap": lambda _: OverlapRerank()}


def embedder(params: dict, dim: int) -> Callable[[Column], Column]:
    """A column function of the provider named in ``params``; an empty or null text is the zero vector."""
    name = params.get("provider", "hash")
    if name not in EMBEDDINGS:
        raise SchemaError(f"unknown embedding provider {name!r}")
    make = EMBEDDINGS[name]

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        texts = [t for t in s if t]
        got = iter(make(params).embed(texts, dim) if texts else [])
        return pd.Series([next(got) if t else [0.0] * dim for t in s])

    return run


def reranker(params: dict, query: str) -> Callable[[Column], Column]:
    """A column function that scores a text column for ``query``; null is 0."""
    name = params.get("provider", "overlap")
    if name not in RERANKERS:
        raise SchemaError(f"unknown rerank provider {name!r}")
    make = RERANKERS[name]

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(make(params).rerank(query, [t or "" for t in s]), dtype=float)

    return run
