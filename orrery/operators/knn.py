"""Exact nearest-neighbour search.

The number and size of the queries are checked before they are broadcast. Searches run as matrix products in Arrow batches (``scan``); each task
keeps its own best k per query before anything is shuffled. ``scored`` is the plain product of rows and queries as column expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.errors import QueryError
from orrery.functions import metrics
from orrery.operators.scan import Range, best_pairs

#: Largest k plus offset of a search.
MOST_HITS = 16_384
#: Components of all query vectors together that are broadcast; more queries are searched in groups of this size.
BROADCAST_COMPONENTS = 4_000_000
#: Groups of a grouped search for which each task keeps the best hits; beyond, all pairs of rows and queries are ranked.
MOST_GROUPS = 1000


def scored(rows: DataFrame, queries: DataFrame, metric: str, vector: str = "vector", query_vector: str = "qvector") -> DataFrame:
    """``rows`` with each of ``queries`` (qid, qvector) and the public ``score``; rows or queries without a vector are left out.

    Vectors of different lengths are an error of the data and score nothing.
    """
    metrics.check_metric(metric)
    if metric == "BM25":
        raise QueryError("BM25 scores text, see bm25")
    left = rows.where(F.col(vector).isNotNull())
    q = queries.where(F.col(query_vector).isNotNull())
    if metric == "COSINE":
        left = left.withColumn("_norm", metrics.norm(F.col(vector)))
        q = q.withColumn("_qnorm", metrics.norm(F.col(query_vector)))
    pairs = None
    for part in broadcastable(q, query_vector):
        met = left.join(F.broadcast(part), F.size(F.col(vector)) == F.size(F.col(query_vector)))
        pairs = met if pairs is None else pairs.unionByName(met)
    if metric == "COSINE":
        score = metrics.cosine(F.col(vector), F.col(query_vector), F.col("_norm"), F.col("_qnorm"))
    else:
        score = metrics.public_score(metric, F.col(vector), F.col(query_vector))
    return pairs.withColumn("score", score).drop(query_vector, "_norm", "_qnorm")


def broadcastable(queries: DataFrame, query_vector: str = "qvector") -> list[DataFrame]:
    """``queries`` in groups of about BROADCAST_COMPONENTS components at most; their size is counted first."""
    size = queries.agg(F.coalesce(F.sum(F.size(query_vector)), F.lit(0))).first()[0]
    n = -(-size // BROADCAST_COMPONENTS)
    return [queries.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == g) for g in range(n)] if n > 1 else [queries]


def order(metric: str, id_col: str = "id") -> list[Column]:
    """Best first, then by id."""
    return [metrics.best_first(metric, F.col("score")), F.col(id_col).asc()]


def check_limits(k: int, offset: int) -> None:
    if k < 1 or offset < 0 or k + offset > MOST_HITS:
        raise QueryError(f"k is at least 1, offset at least 0 and their sum at most {MOST_HITS}")


def top_k(hits: DataFrame, by: list[Column], k: int, offset: int = 0, rank: str = "rank") -> DataFrame:
    """Per qid the hits ``offset`` + 1 to ``offset`` + k in the given order, with their rank from 1."""
    check_limits(k, offset)
    ranked = hits.withColumn(rank, F.row_number().over(Window.partitionBy("qid").orderBy(*by))).where(F.col(rank) <= k + offset)
    return ranked.where(F.col(rank) > offset).withColumn(rank, F.col(rank) - offset) if offset else ranked


def grouped_top_k(hits: DataFrame, by: list[Column], group: str, groups: int, size: int = 1, strict: bool = False, offset: int = 0) -> DataFrame:
    """Per qid the best ``groups`` groups after ``offset``, each with its best ``size`` hits.

    Groups are ordered by their best hit; null is a group. ``strict`` leaves out groups with fewer than ``size`` hits before
    groups are counted. Adds group_rank and rank (within the group). The hits are computed once.
    """
    if groups < 1 or size < 1 or offset < 0:
        raise QueryError("limit and group_size are at least 1, offset at least 0")
    own = Window.partitionBy("qid", group)
    within = hits.withColumn("rank", F.row_number().over(own.orderBy(*by))).where(F.col("rank") <= size)
    if strict:
        within = within.withColumn("_n", F.count(F.lit(1)).over(own)).where(F.col("_n") == size).drop("_n")
    out = numbered_groups(within, by, group)
    return out.where((F.col("group_rank") <= groups + offset) & (F.col("group_rank") > offset)).withColumn("group_rank", F.col("group_rank") - offset)


def numbered_groups(within: DataFrame, by: list[Column], group: str) -> DataFrame:
    """``within``, hits with their rank in their group, with group_rank: the place of the group's first hit among first hits, by ``by``."""
    first = F.col("rank") == 1
    so_far = F.count(F.when(first, F.lit(1))).over(Window.partitionBy("qid").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = Window.partitionBy("qid", group)
    return within.withColumn("_at", so_far).withColumn("group_rank", F.max(F.when(first, F.col("_at"))).over(own)).drop("_at")


def knn(rows: DataFrame, queries: DataFrame, metric: str = "COSINE", k: int = 10, *, where: Column | None = None, radius: float | None = None, range_filter: float | None = None, offset: int = 0, group_by: str | None = None, group_size: int = 1, strict: bool = False, vector: str = "vector", id_col: str = "id", also: tuple[str, ...] = ()) -> DataFrame:
    """Per query (qid, qvector) the best rows with their public score and rank, and all columns of theirs but the vector.

    Filters and ranges apply before the top-k, so the result never has fewer hits than exist. ``also``: metrics whose scores the hits get, too,
    as score_l2 and so on.
    """
    if where is not None:
        rows = rows.where(where)
    if radius is not None and range_filter is not None:
        low, high = (radius, range_filter) if metric not in metrics.ASCENDING else (range_filter, radius)
        if low >= high:
            raise QueryError("radius and range_filter leave nothing between them")
    check_limits(k, offset)
    carry = [c for c in rows.columns if c not in (vector, id_col)]
    if group_by is not None:
        if few_groups(rows, group_by):
            hits = best_pairs(rows, queries, metric, group_size, vector=vector, id_col=id_col, carry=carry, group=group_by, within=limits(metric, radius, range_filter), also=also)
        else:
            hits = scored(rows, queries, metric, vector)
            if radius is not None or range_filter is not None:
                hits = hits.where(metrics.in_range(metric, F.col("score"), radius, range_filter))
        return grouped_top_k(hits, order(metric, id_col), group_by, k, group_size, strict, offset)
    hits = best_pairs(rows, queries, metric, k + offset, vector=vector, id_col=id_col, carry=carry, within=limits(metric, radius, range_filter), also=also)
    return top_k(hits, order(metric, id_col), k, offset)


def limits(metric: str, radius: float | None, range_filter: float | None) -> Range | None:
    """As ``metrics.in_range``."""
    if radius is None and range_filter is None:
        return None
    if metric in metrics.ASCENDING:
        return Range(-math.inf if range_filter is None else range_filter, math.inf if radius is None else radius, low_closed=True)
    return Range(-math.inf if radius is None else radius, math.inf if range_filter is None else range_filter, high_closed=True)


def few_groups(rows: DataFrame, group: str) -> bool:
    return rows.select(group).distinct().limit(MOST_GROUPS + 1).count() <= MOST_GROUPS


def knn_matrix(rows: DataFrame, queries: DataFrame, metric: str, k: int, vector: str = "vector", id_col: str = "id") -> DataFrame:
    """(qid, id, score, rank) and nothing else of the rows; ids are longs."""
    check_limits(k, 0)
    some = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("vector"))
    asked = queries.select(F.col("qid").cast("long").alias("qid"), "qvector")
    return top_k(best_pairs(some, asked, metric, k), order(metric), k)
