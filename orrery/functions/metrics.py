"""Distances of dense vectors as column expressions in double precision, and score conventions.

Public scores: COSINE the cosine, IP the dot product (both: more is better), L2 the squared distance (less is
better), BM25 the negative relevance. Engine distances (less is better everywhere): ``1 - cosine``, ``-dot``, the
Euclidean distance, ``-relevance``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.errors import QueryError

METRICS = ("COSINE", "IP", "L2", "BM25")
#: Metrics whose public score falls as the match gets better.
ASCENDING = ("L2", "BM25")


def check_metric(name: str) -> str:
    if name not in METRICS:
        raise QueryError(f"metric {name!r} is none of {', '.join(METRICS)}")
    return name


def _sum(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 where one vector is zero; at most 1."""
    length = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(length == 0, F.lit(0.0)).otherwise(F.least(dot(a, b) / F.when(length != 0, length), F.lit(1.0)))


def public_score(metric: str, a: Column, b: Column) -> Column:
    return {"COSINE": cosine, "IP": dot, "L2": squared_distance}[metric](a, b)


def engine_distance(metric: str, score: Column) -> Column:
    """From the public score."""
    return {"COSINE": lambda s: 1 - s, "IP": lambda s: -s, "L2": F.sqrt, "BM25": lambda s: s}[metric](score)


def from_engine_distance(metric: str, d: Column) -> Column:
    return {"COSINE": lambda s: 1 - s, "IP": lambda s: -s, "L2": lambda s: s * s, "BM25": lambda s: s}[metric](d)


def best_first(metric: str, score: Column) -> Column:
    return score.asc() if metric in ASCENDING else score.desc()


def in_range(metric: str, score: Column, radius: float | None, range_filter: float | None) -> Column:
    """COSINE and IP: radius < score <= range_filter; L2 and BM25: range_filter <= score < radius."""
    ok = F.lit(True)
    up = metric not in ASCENDING
    if radius is not None:
        ok = ok & (score > radius if up else score < radius)
    if range_filter is not None:
        ok = ok & (score <= range_filter if up else score >= range_filter)
    return ok


def normalised(metric: str, score: Column) -> Column:
    """A relevance from 0 to 1 of a public score (BM25: of the positive relevance)."""
    return {
        "COSINE": lambda s: (1 + s) / 2,
        "IP": lambda s: F.atan(s) / math.pi + 0.5,
        "BM25": lambda s: 2 * F.atan(s) / math.pi,
        "L2": lambda s: 1 - 2 * F.atan(s) / math.pi,
    }[metric](score)
