"""The best rows of many queries in one pass over the rows, exactly and in bounded memory.

A task holds blocks of rows against blocks of queries as matrix products. A product only rules pairs out: a pair stays if its product, with the
rounding error that it may have, reaches the worst hit that its query keeps. Pairs that stay are scored component by component, with the bits that
the column functions of ``metrics`` give, so equal vectors have equal scores wherever they lie. A task sends its best k of each query and nothing else.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.errors import QueryError
from orrery.functions import metrics

#: Hits that a task keeps at least for all queries of a group together, k for each; more queries are searched in further groups.
POOL = 500_000
#: Rows and queries of a block, and pairs that are scored at once.
TILE, PAIRS = 1024, 1 << 16
#: Rows go through so many tasks at most, or one for each core if there are more: what all tasks send grows with the queries, not with the rows.
TASKS = 12


@dataclass(frozen=True)
class Range:
    """Scores that count: above ``low`` (from it on, if closed), below ``high``."""

    low: float = -math.inf
    high: float = math.inf
    low_closed: bool = False
    high_closed: bool = False

    def holds(self, s: np.ndarray) -> np.ndarray:
        """NaN is larger than any number, as in Spark."""
        above = s >= self.low if self.low_closed else s > self.low
        below = s <= self.high if self.high_closed else s < self.high
        return (above | np.isnan(s) | (self.low == -math.inf)) & (below | (self.high == math.inf))


@dataclass(frozen=True)
class Weight:
    """What the order of the rows takes instead of the score: the score times ``value`` (scale), or boosted by it where ``where`` holds (multiply, sum).

    ``nan_last``: NaN is the worst, not the largest.
    """

    how: str
    value: Column
    where: Column | None = None
    nan_last: bool = False


@dataclass
class _Plan:
    """What a task needs besides the rows; arrays of queries by the number of their components."""

    metric: str
    k: int
    qid: pa.Array
    blocks: dict[int, tuple[np.ndarray, np.ndarray]]  # places of the queries, their vectors
    range: Range | None = None
    how: str | None = None
    nan_last: bool = False
    grouped: bool = False
    also: tuple[str, ...] = ()
    lists: np.ndarray | None = None  # of each list, in bits, the queries that look into it
    buckets: np.ndarray | None = None  # of a query its bucket in each table


def best_pairs(
    rows: DataFrame,
    queries: DataFrame,
    metric: str,
    k: int,
    *,
    vector: str = "vector",
    id_col: str = "id",
    carry: list[str] = (),
    group: str | None = None,
    within: Range | None = None,
    weight: Weight | None = None,
    also: tuple[str, ...] = (),
    dim: int | None = None,
    lists_of: Callable[[np.ndarray], np.ndarray] | None = None,
    buckets_of: Callable[[np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """(qid, id, score, the scores ``also`` by other metrics, the columns ``carry``): the k best rows of each query, or of each query and ``group``, in every task.

    They hold the k best of all; ties go to the smaller id. ``weight`` changes the order, not the score. For an index of vectors of ``dim`` components
    ``lists_of`` says of query vectors which lists they look into (queries by lists; rows have a column list), ``buckets_of`` in which bucket of each table
    they are (queries by tables; rows have a column buckets): other pairs are left out. Vectors with a null in them are left out like null vectors.
    """
    metrics.check_metric(metric)
    if metric == "BM25":
        raise QueryError("BM25 scores text, see bm25")
    spark = rows.sparkSession
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    out = T.StructType([T.StructField("qid", queries.schema["qid"].dataType), T.StructField(id_col, kinds[id_col]), T.StructField("score", T.DoubleType()), *[T.StructField(f"score_{m.lower()}", T.DoubleType()) for m in also], *[T.StructField(c, kinds[c]) for c in carry]])
    extra = [F.col(group).alias("_group")] if group else []
    if weight is not None:
        extra += [weight.value.cast("double").alias("_weight"), F.coalesce(weight.where if weight.where is not None else F.lit(True), F.lit(False)).alias("_weighed")]
    extra += [F.col("list").alias("_list")] if lists_of is not None else []
    extra += [F.col("buckets").alias("_buckets")] if buckets_of is not None else []
    source = rows.where(F.col(vector).isNotNull())
    many = source.select(group).distinct().count() if group else 1
    source = source.select(F.col(vector).alias("_vector"), *extra, F.col(id_col), *[F.col(c) for c in carry]).coalesce(max(TASKS, spark.sparkContext.defaultParallelism))
    step, parts = max(1, POOL // (k * max(1, many))), []
    for asked in collected(queries, step):
        blocks = {d: x for d, x in _blocks(asked.column(1).combine_chunks()).items() if dim in (None, d)}
        probed = lists = buckets = None
        if lists_of is not None and blocks:
            probed = lists_of(blocks[dim][1])
            lists = np.packbits(probed.T, axis=1)
        if buckets_of is not None and blocks:
            buckets = np.asarray(buckets_of(blocks[dim][1]), dtype=np.int32)
        if blocks:
            plan = _Plan(metric, k, asked.column(0).combine_chunks(), blocks, within, weight.how if weight else None, weight is not None and weight.nan_last, group is not None, tuple(also), lists, buckets)
            read = source if probed is None or probed.all() else source.where(F.col("_list").isin([int(n) for n in np.flatnonzero(probed.any(0))]))
            parts.append(read.mapInArrow(_task(spark.sparkContext.broadcast(plan)), out))
    if not parts:
        return spark.createDataFrame([], out)
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    return hits


def collected(queries: DataFrame, step: int) -> Iterator[pa.Table]:
    """(qid, qvector) of ``step`` queries at most."""
    from orrery.operators.knn import broadcastable

    for part in broadcastable(queries.where(F.col("qvector").isNotNull()).select("qid", "qvector")):
        got = part.toArrow()
        for at in range(0, got.num_rows, step):
            yield got.slice(at, step)


def matrix(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the vectors of ``dim`` components without nulls, these vectors in double precision)."""
    at = np.flatnonzero(pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False) == dim)
    flat = (lists if len(at) == len(lists) else lists.take(pa.array(at))).flatten()
    v = np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(at), dim)
    if flat.null_count:
        whole = ~np.asarray(flat.is_null().to_numpy(zero_copy_only=False)).reshape(len(at), dim).any(1)
        at, v = at[whole], v[whole]
    return at, v


def _blocks(lists: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    dims = [int(d) for d in pc.unique(pc.list_value_length(lists)).to_pylist()]
    return {d: found for d in dims if len((found := matrix(lists, d))[0])}


def _task(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(shared.value)
        with np.errstate(all="ignore"):
            for b in batches:
                for at in range(0, b.num_rows, 4 * TILE):
                    best.add(b.slice(at, 4 * TILE))
            yield from best.result()

    return run


def _length(v: np.ndarray) -> np.ndarray:
    """Norms, added up in the order of the components."""
    total = np.zeros(len(v))
    for x in np.ascontiguousarray(v.T):
        total += x * x
    return np.sqrt(total)


class _Side:
    """Vectors with their norms, as they are multiplied: unit vectors for COSINE, NaN where a product says nothing about the exact score."""

    def __init__(self, v: np.ndarray, metric: str):
        self.t, self.norm, self.most = np.ascontiguousarray(v.T), _length(v), 0.0
        sound = (self.norm < 1e100) & ((self.norm > 1e-100) | (self.norm == 0))
        self.odd = not sound.all()
        self.unit = v
        if metric == "COSINE":
            self.unit = v / np.where(self.norm > 0, self.norm, 1)[:, None]
        if self.odd:
            self.unit = np.where(sound[:, None], self.unit, np.nan)
        self.bound = np.where(sound, 1.0 if metric == "COSINE" else self.norm, 0.0)


class _Best:
    def __init__(self, plan: _Plan):
        self.plan, self.n = plan, len(plan.qid)
        self.asked = {d: (at, _Side(v, plan.metric)) for d, (at, v) in plan.blocks.items()}
        self.up = plan.metric not in metrics.ASCENDING
        self.pool: list[tuple[np.ndarray, ...]] = []
        self.held = self.since = 0
        self.rows: list[pa.RecordBatch] = []
        self.codes: list[np.ndarray] = []
        self.stored = 0
        self.groups: dict[object, int] = {}
        self.worst: list[np.ndarray] = [] if plan.grouped else [np.full(self.n, -np.inf)]  # of each group and query the key of its last hit, or a bound of it

    def add(self, b: pa.RecordBatch) -> None:
        p = self.plan
        names = b.schema.names
        for dim, (places, q) in self.asked.items():
            at, v = matrix(b.column(0), dim)
            if not len(at):
                continue
            own = b if len(at) == b.num_rows else b.take(pa.array(at))
            x = _Side(v, p.metric)
            col = lambda name: own.column(names.index(name))  # noqa: E731, B023
            weight = (np.asarray(col("_weight").to_numpy(zero_copy_only=False), dtype=np.float64), np.asarray(col("_weighed").to_numpy(zero_copy_only=False), dtype=bool)) if p.how else None
            buckets = np.asarray(col("_buckets").flatten().to_numpy(zero_copy_only=False), dtype=np.int32).reshape(len(at), -1) if p.buckets is not None else None
            kept = [c for c in names if c not in ("_vector", "_group", "_weight", "_weighed", "_list", "_buckets")]
            record = own.select(kept)
            group = self._codes(col("_group")) if p.grouped else np.zeros(len(at), dtype=np.int32)
            lists = np.asarray(col("_list").to_numpy(zero_copy_only=False), dtype=np.int64) if p.lists is not None else None
            found: list[tuple[np.ndarray, ...]] = []
            for g, i in _parts(group if lists is None else lists):
                worst = self.worst[g if p.grouped else 0]
                j = np.arange(len(places)) if lists is None else np.flatnonzero(np.unpackbits(p.lists[g])[: len(places)])
                for a in range(0, len(i), TILE):
                    for c in range(0, len(j), TILE):
                        some = self._tile(x, q, i[a : a + TILE], j[c : c + TILE], places, worst, weight, buckets)
                        if some is not None:
                            found.append(some)
                            self.since += len(some[0])
                    if self.since > max(200_000, 2 * p.k * self.n * max(1, len(self.worst))):
                        self._keep(record, group, found)
                        found = []
                        self.cut()
            self._keep(record, group, found)

    def _codes(self, group: pa.Array) -> np.ndarray:
        """Small numbers for the values of a group column; null is one."""
        enc = group.dictionary_encode(null_encoding="encode")
        new = np.zeros(len(enc.dictionary), dtype=np.int32)
        for n, value in enumerate(enc.dictionary.to_pylist()):
            key = "NaN" if isinstance(value, float) and value != value else (value,)
            if key not in self.groups:
                self.groups[key] = len(self.groups)
                self.worst.append(np.full(self.n, -np.inf))
            new[n] = self.groups[key]
        return new[enc.indices.to_numpy(zero_copy_only=False)]

    def _keep(self, record: pa.RecordBatch, group: np.ndarray, found: list[tuple[np.ndarray, ...]]) -> None:
        if not found:
            return
        all_ = [np.concatenate(c) for c in zip(*found)]
        used, place = np.unique(all_[1], return_inverse=True)
        self.pool.append((all_[0], place.astype(np.int64) + self.stored, *all_[2:]))
        self.rows.append(record.take(pa.array(used)))
        self.codes.append(group[used])
        self.stored += len(used)

    def _tile(self, x: _Side, q: _Side, i: np.ndarray, j: np.ndarray, places: np.ndarray, worst: np.ndarray, weight: tuple[np.ndarray, np.ndarray] | None, buckets: np.ndarray | None) -> tuple[np.ndarray, ...] | None:
        p = self.plan
        dim = len(x.t)
        off = 4e-16 * (dim + 16)
        key = q.unit[j] @ x.unit[i].T
        most = x.bound[i].max(initial=0.0)
        if p.metric == "L2":
            key *= 2
            key -= (q.bound[j] ** 2)[:, None]
            key -= (x.bound[i] ** 2)[None, :]
            slack = off * (q.bound[j] + most) ** 2 + 1e-290
        else:
            slack = off * q.bound[j] * most + 1e-290
        low, high = (-math.inf, math.inf) if p.range is None else (p.range.low, p.range.high) if self.up else (-p.range.high, -p.range.low)
        inside = key if p.range is not None else None  # the range is of the score, not of the weighed one
        near = slack
        if weight is not None:
            key, slack = self._weigh_about(key, slack, weight[0][i], weight[1][i], off, most, q.bound[j])
        mine = places[j]
        least = worst[mine]
        unset = np.flatnonzero(np.isneginf(least))
        met = None
        if buckets is not None and len(unset):
            met = _meet(p.buckets[j], buckets[i])
        if len(unset) and len(i) >= p.k:
            sure = np.fmax(key[unset], -np.inf)
            if inside is not None:
                sure[~((inside[unset] > low + near[unset, None]) & (inside[unset] < high - near[unset, None]))] = -np.inf
            if met is not None:
                sure[~met[unset]] = -np.inf
            bound = np.partition(sure, len(i) - p.k, axis=1)[:, len(i) - p.k] - slack[unset]
            least[unset] = np.where(np.isnan(bound), -np.inf, bound)
            worst[mine] = least
        stays = ~(key < (least - slack)[:, None])
        if inside is not None:
            stays &= ~((inside < low - near[:, None]) | (inside > high + near[:, None]))
        if met is not None:
            stays &= met
        flat = np.flatnonzero(stays)
        if not len(flat):
            return None
        jj, ii = np.divmod(flat, len(i))
        jj, ii = j[jj], i[ii]
        if buckets is not None and met is None:
            sharing = np.concatenate([(p.buckets[jj[a : a + PAIRS]] == buckets[ii[a : a + PAIRS]]).any(1) for a in range(0, len(jj), PAIRS)])
            jj, ii = jj[sharing], ii[sharing]
        parts = []
        for a in range(0, len(jj), PAIRS):
            r, c = ii[a : a + PAIRS], jj[a : a + PAIRS]
            s = exact(p.metric, x, q, r, c)
            k = s if weight is None else self._weigh(s, weight[0][r], weight[1][r])
            k = k if self.up else -k
            k = np.where(np.isnan(k), np.inf if self.up and not p.nan_last else -np.inf, k)
            good = ~(k < worst[places[c]])
            if p.range is not None:
                good &= p.range.holds(s)
            r, c, s, k = r[good], c[good], s[good], k[good]
            parts.append((places[c], r, k, s, *[exact(m, x, q, r, c) for m in p.also]))
        return tuple(np.concatenate(y) for y in zip(*parts)) if parts else None

    def _weigh_about(self, key: np.ndarray, slack: np.ndarray, value: np.ndarray, where: np.ndarray, off: float, most: float, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weighed keys and their error; rows whose value isn't finite stay."""
        value = np.where(np.isfinite(value) | ~where, value, np.nan)
        a = np.where(where & (self.plan.how != "sum"), value, 1.0)
        b = np.where(where & (self.plan.how == "sum"), value, 0.0)
        ma, mb = np.fmax.reduce(np.abs(a), initial=1.0), np.fmax.reduce(np.abs(b), initial=0.0)
        if self.plan.metric == "L2" and self.plan.how != "scale":
            d = np.sqrt(np.maximum(-key, 0.0)) * a + b
            far = np.fmax.reduce(np.abs(d), axis=1, initial=0.0)
            slack = np.sqrt(slack) * ma + 4 * off * (far + mb)
            return -d * d, 2 * far * slack + slack * slack + 4 * off * far * far
        return key * a + (b if self.up else -b), slack * ma + 4 * off * (ma * (1 + most * bound) + mb) + (off * (bound + most) ** 2 * ma if not self.up else 0)

    def _weigh(self, s: np.ndarray, value: np.ndarray, where: np.ndarray) -> np.ndarray:
        """As ``fusion.boost`` and products of columns do it."""
        if self.plan.how == "scale":
            return np.where(where, s * value, s)
        metric = self.plan.metric
        d = {"COSINE": lambda: 1 - s, "IP": lambda: -s, "L2": lambda: np.sqrt(s)}[metric]()
        if self.plan.how == "multiply":
            new = 1 - (1 - d) * value if metric == "COSINE" else d * value
        else:
            new = d + value if metric == "L2" else d - value
        return np.where(where, {"COSINE": lambda: 1 - new, "IP": lambda: -new, "L2": lambda: new * new}[metric](), s)

    def cut(self) -> None:
        """Leaves the k best of each query, or of each query and group, and the rows that they name."""
        self.since = 0
        if not self.pool:
            return
        q, row, key, *rest = (np.concatenate(c) for c in zip(*self.pool))
        store = pa.Table.from_batches(self.rows).combine_chunks()
        code = np.concatenate(self.codes)
        ids = np.empty(self.stored, dtype=np.int64)
        ids[pc.array_sort_indices(store.column(0).combine_chunks(), null_placement="at_start").to_numpy()] = np.arange(self.stored)
        by = (ids[row], -key, code[row], q) if self.plan.grouped else (ids[row], -key, q)
        order = np.lexsort(by)
        q, row, key = q[order], row[order], key[order]
        of = q.astype(np.int64) * max(1, len(self.worst)) + (code[row] if self.plan.grouped else 0)
        start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        rank = np.arange(len(of)) - np.repeat(start, np.diff(np.r_[start, len(of)]))
        last = np.flatnonzero(rank == self.plan.k - 1)
        for g in range(len(self.worst)):
            own = last if not self.plan.grouped else last[code[row[last]] == g]
            self.worst[g][q[own]] = np.maximum(self.worst[g][q[own]], key[own])
        keep = rank < self.plan.k
        used, place = np.unique(row[keep], return_inverse=True)
        self.pool = [(q[keep], place.astype(np.int64), key[keep], *[r[order][keep] for r in rest])]
        self.rows, self.codes, self.stored = store.take(pa.array(used)).combine_chunks().to_batches(), [code[used]], len(used)

    def result(self) -> Iterator[pa.RecordBatch]:
        self.cut()
        if not self.pool:
            return
        q, row, _, *scores = self.pool[0]
        store = pa.Table.from_batches(self.rows)
        for a in range(0, len(q), PAIRS):
            some = store.take(pa.array(row[a : a + PAIRS])).combine_chunks()
            cols = [self.plan.qid.take(pa.array(q[a : a + PAIRS])), some.column(0), *[pa.array(s[a : a + PAIRS]) for s in scores], *some.columns[1:]]
            names = ["qid", some.column_names[0], "score", *[f"score_{m.lower()}" for m in self.plan.also], *some.column_names[1:]]
            yield from pa.table(cols, names=names).combine_chunks().to_batches()


def exact(metric: str, x: _Side, q: _Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The public scores of pairs, added up in the order of the components as ``metrics`` does."""
    total = np.zeros(len(i))
    for a, b in zip(x.t, q.t):
        if metric == "L2":
            d = a[i] - b[j]
            total += d * d
        else:
            total += a[i] * b[j]
    if metric == "COSINE":
        length = x.norm[i] * q.norm[j]
        s = total / np.where(length != 0, length, 1)
        return np.where(length == 0, 0.0, np.where(np.isnan(s), 1.0, np.minimum(s, 1.0)))  # the least of NaN and 1 is 1 in Spark
    return total


def _parts(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each value."""
    order = np.argsort(values, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(values[order])) + 1):
        yield int(values[part[0]]), part


def _meet(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Queries by rows: whether they share a bucket."""
    met = np.zeros((len(queries), len(rows)), dtype=bool)
    for t in range(queries.shape[1]):
        met |= queries[:, t][:, None] == rows[:, t][None, :]
    return met
