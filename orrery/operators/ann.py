"""Approximate search: inverted lists over centroids, with or without 8-bit components, and random projections.

An index is fitted on a bounded sample and holds every row. Search probes the lists of the nearest centroids; the
lists are a partition column, so that a scan of the written index reads the probed ones only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.errors import QueryError
from orrery.operators.knn import order, top_k
from orrery.operators.scan import best_pairs

#: Vectors that centroids and component ranges are fitted on, at most; which ones depends on the id alone.
FIT_ROWS = 20_000
#: Lists, if none are asked for: the root of the number of vectors, within these bounds.
LEAST_LISTS, MOST_LISTS = 16, 4096
#: What an index is set to find of the 10 nearest: so many vectors of the sample are searched in it when it is built, and the least effort that finds
#: that much of what an exact search in the sample finds is the effort of a search that doesn't ask for another.
TARGET = 0.96
TRIALS = 256
#: Vectors that are held against all centroids at once.
BLOCK = 1024
#: Tables of random projections, and the numbers of bits that are tried, the most selective first.
TABLES = 32
BITS = (12, 10, 8, 7, 6, 5, 4, 3, 2)


@dataclass
class IvfIndex:
    """``rows`` (id, vector or code, list) and what is needed to search them."""

    rows: DataFrame
    centroids: np.ndarray
    metric: str
    low: np.ndarray | None = None
    step: np.ndarray | None = None
    nprobe: int = 1

    def write(self, path: str) -> None:
        """Lists as folders, the rows of a list in one file."""
        self.rows.repartition("list").write.partitionBy("list").parquet(path)


def _sample(rows: DataFrame, vector: str, id_col: str, most: int) -> np.ndarray:
    good = rows.where(F.col(vector).isNotNull())
    n = good.count()
    if n > most:
        good = good.where(F.abs(F.xxhash64(id_col) % 1_000_003) < int(1_000_003 * most / n))
    got = good.select(vector).limit(2 * most).collect()
    return np.array([r[0] for r in got], dtype=np.float64)


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 0) -> np.ndarray:
    """Lloyd's algorithm from distinct random rows; empty clusters keep their centre."""
    k = max(1, min(k, len(x)))
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        d = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :]
        near = d.argmin(1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1))[:, None]
    return np.where(n > 0, x / np.where(n > 0, n, 1), 0.0)


def _nearest(x: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(places of some of ``x``, for each the places of its 10 nearest in ``x``)."""
    some = np.random.default_rng(3).permutation(len(x))[:TRIALS]
    s = x[some] @ x.T if metric != "L2" else 2 * x[some] @ x.T - (x * x).sum(1)[None, :]
    return some, np.argsort(-s, axis=1, kind="stable")[:, :10]


def _probes(x: np.ndarray, c: np.ndarray, metric: str) -> int:
    """The least number of lists that hold TARGET of the nearest of the sample's trials."""
    far = (c * c).sum(1)[None, :] - 2 * x @ c.T
    own = far.argmin(1)
    some, top = _nearest(x, metric)
    place = np.argsort(np.argsort(far[some], axis=1, kind="stable"), axis=1, kind="stable")  # of each list, by distance
    needed = np.take_along_axis(place, own[top], axis=1).ravel() + 1
    return int(np.sort(needed)[max(0, math.ceil(TARGET * len(needed)) - 1)])


def build_ivf(rows: DataFrame, metric: str = "L2", nlist: int | None = None, *, sq8: bool = False, vector: str = "vector", id_col: str = "id", fit_rows: int = FIT_ROWS) -> IvfIndex:
    """Assigns every row with a vector to its nearest centroid; ``sq8`` stores a byte a component, scaled between the sample's extremes."""
    x = _sample(rows, vector, id_col, fit_rows)
    if not len(x):
        raise QueryError("there is no vector to index")
    if metric == "COSINE":
        x = _unit(x)
    if nlist is None:
        nlist = max(LEAST_LISTS, min(MOST_LISTS, math.isqrt(rows.where(F.col(vector).isNotNull()).count())))
    c = kmeans(x, nlist)
    low, high = x.min(0), x.max(0)
    step = np.maximum((high - low) / 255, 1e-12)
    shared = rows.sparkSession.sparkContext.broadcast((c, low, step))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, low, step = shared.value
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            v = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, -1)
            u = _unit(v) if metric == "COSINE" else v
            near = np.concatenate([((c * c).sum(1)[None, :] - 2 * u[at : at + BLOCK] @ c.T).argmin(1) for at in range(0, n, BLOCK)])
            out = u if sq8 else v
            if sq8:
                out = np.clip(np.rint((u - low) / step), 0, 255) * step + low
            flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * v.shape[1]), pa.array(out.ravel().astype(np.float32)))
            yield pa.record_batch([b.column(0), flat, pa.array(near.astype(np.int32))], names=["id", "vector", "list"])

    kind = rows.schema[id_col].dataType.simpleString()
    listed = rows.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), vector).mapInArrow(assign, f"id {kind}, vector array<float>, list int")
    return IvfIndex(listed, c, metric, low if sq8 else None, step if sq8 else None, _probes(x, c, metric))


def search_ivf(index: IvfIndex, queries: DataFrame, k: int = 10, nprobe: int | None = None) -> DataFrame:
    """(qid, id, score, rank) from the ``nprobe`` lists nearest to each query; as many as the index was set to, if no number is given."""
    c, metric = index.centroids, index.metric
    nprobe = max(1, min(index.nprobe if nprobe is None else nprobe, len(c)))

    def lists_of(q: np.ndarray) -> np.ndarray:
        probed = np.zeros((len(q), len(c)), dtype=bool)
        for at in range(0, len(q), BLOCK):
            u = _unit(q[at : at + BLOCK]) if metric == "COSINE" else q[at : at + BLOCK]
            d = (c * c).sum(1)[None, :] - 2 * u @ c.T
            np.put_along_axis(probed[at : at + BLOCK], np.argsort(d, axis=1, kind="stable")[:, :nprobe], True, axis=1)
        return probed

    hits = best_pairs(index.rows, queries, metric, k, dim=c.shape[1], lists_of=lists_of)
    return top_k(hits, order(metric), k)


def fit_lsh(rows: DataFrame, metric: str, dim: int, tables: int = TABLES, *, vector: str = "vector", id_col: str = "id", seed: int = 1) -> int:
    """The most bits a bucket with which the tables find TARGET of the nearest of the sample's trials."""
    x = _sample(rows, vector, id_col, FIT_ROWS)
    if not len(x):
        return BITS[-1]
    some, top = _nearest(_unit(x) if metric == "COSINE" else x, metric)
    for bits in BITS:
        planes = np.random.default_rng(seed).standard_normal((dim, tables * bits))
        b = ((x @ planes > 0).reshape(len(x), tables, bits) * (1 << np.arange(bits))).sum(2)
        if (b[top] == b[some][:, None, :]).any(2).mean() >= TARGET:
            return bits
    return BITS[-1]


def _buckets(v: np.ndarray, planes: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """Vectors by tables; buckets of different tables have different numbers."""
    return ((v @ planes > 0).reshape(len(v), tables, bits) * (1 << np.arange(bits))).sum(2) + np.arange(tables) * (1 << bits)


def build_lsh(rows: DataFrame, tables: int, bits: int, *, vector: str = "vector", id_col: str = "id", dim: int, seed: int = 1) -> DataFrame:
    """(id, vector, buckets): signs of seeded random projections, one bucket for each table."""
    planes = np.random.default_rng(seed).standard_normal((dim, tables * bits))
    shared = rows.sparkSession.sparkContext.broadcast(planes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(b.num_rows, -1)
                s = _buckets(v, shared.value, tables, bits)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * tables), pa.array(s.ravel().astype(np.int32)))
                yield pa.record_batch([b.column(0), b.column(1), lists], names=["id", "vector", "buckets"])

    kind = rows.schema[id_col].dataType.simpleString()
    vkind = rows.schema[vector].dataType.simpleString()
    return rows.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("vector")).mapInArrow(run, f"id {kind}, vector {vkind}, buckets array<int>")


def search_lsh(index: DataFrame, queries: DataFrame, metric: str, k: int, dim: int, tables: int, bits: int, seed: int = 1) -> DataFrame:
    """(qid, id, score, rank) of the rows that share a bucket with a query.

    Each task holds its rows against all queries: where buckets are as wide as they have to be for most pairs to share one, a join of buckets
    would write nearly all pairs.
    """
    planes = np.random.default_rng(seed).standard_normal((dim, tables * bits))
    hits = best_pairs(index, queries, metric, k, dim=dim, buckets_of=lambda q: _buckets(q, planes, tables, bits))
    return top_k(hits, order(metric), k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact (qid, id) pairs that were found."""
    n = exact.count()
    return exact.select("qid", "id").join(found.select("qid", "id"), ["qid", "id"]).count() / n if n else 1.0
