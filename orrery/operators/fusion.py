"""Fusion of ranked routes and reranking expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.errors import QueryError
from orrery.functions import metrics
from orrery.operators.knn import numbered_groups

SCORERS = "avg max sum".split()
MODES = "avg max min multiply sum weighted".split()


def merge(routes: list[tuple[DataFrame, str]], how: str = "rrf", *, k: float = 60, weights: list[float] | None = None, norm_score: bool = True, force_descending: bool = False) -> DataFrame:
    """Fuses ``routes``, pairs of (hits, metric), hits being (qid, id, score, ...), to (qid, id, score, ...).

    rrf: sum of 1 / (k + rank); weighted: sum of weight times normalised score, a missing route adds 0; max, sum and avg: of the
    scores of the routes that hit (avg: only those). max, sum and avg turn L2 to a relevance if metrics are mixed or ``force_descending``.
    Other columns come from the first route that has the hit. Best is the largest score, but for max, sum and avg of L2 alone the smallest.
    """
    if not routes:
        raise QueryError("there is no route")
    if how == "rrf" and not 0 < k < 16384:
        raise QueryError("k of rrf lies between 0 and 16384")
    if how == "weighted":
        if weights is None or len(weights) != len(routes):
            raise QueryError("weighted needs a weight for each route")
        if any(not 0 <= w <= 1 for w in weights):
            raise QueryError("weights lie between 0 and 1")
    if how not in ("rrf", "weighted", *SCORERS):
        raise QueryError(f"unknown fusion {how!r}")
    names = [m for _, m in routes]
    convert = force_descending or len({m in metrics.ASCENDING for m in names}) > 1 or len(set(names)) > 1
    parts = []
    for i, (hits, metric) in enumerate(routes):
        metrics.check_metric(metric)
        s = F.col("score")
        if how == "rrf":
            by = s.asc() if metric == "L2" else s.desc()
            hits = hits.withColumn("_rank", F.row_number().over(Window.partitionBy("qid").orderBy(by, F.col("id").asc())))
            s = 1 / (F.lit(float(k)) + F.col("_rank"))
        elif how == "weighted":
            s = F.lit(float(weights[i])) * (metrics.normalised(metric, s) if norm_score else s)
        elif convert and metric == "L2":
            s = metrics.normalised("L2", s)
        rest = [c for c in hits.columns if c not in ("qid", "id", "score", "_rank", "rank")]
        parts.append(hits.select("qid", "id", s.alias("_s"), F.lit(i).alias("_route"), F.struct(*[F.col(c) for c in rest], F.lit(0).alias("_")).alias("_row")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p) if p.schema == parts[0].schema else both.unionByName(p.withColumn("_row", F.col("_row").cast(both.schema["_row"].dataType)) if len(p.schema["_row"].dataType) == len(both.schema["_row"].dataType) else _pad(p, both))
    agg = {"rrf": F.sum, "weighted": F.sum, "sum": F.sum, "max": F.max, "avg": F.avg}[how]
    out = both.groupBy("qid", "id").agg(agg("_s").alias("score"), F.min_by("_row", "_route").alias("_row"))
    rest = [f.name for f in out.schema["_row"].dataType if f.name != "_"]
    return out.select("qid", "id", "score", *[F.col(f"_row.{c}").alias(c) for c in rest])


def _pad(p: DataFrame, like: DataFrame) -> DataFrame:
    have = [f.name for f in p.schema["_row"].dataType]
    want = like.schema["_row"].dataType
    return p.withColumn("_row", F.struct(*[(F.col(f"_row.{f.name}") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in want]))


def merged_ascending(routes_metrics: list[str], how: str, force_descending: bool = False) -> bool:
    """Whether the smallest merged score is the best."""
    return how in SCORERS and not force_descending and set(routes_metrics) == {"L2"}


def sort_key(col: str, descending: bool = True) -> list[Column]:
    """Nulls and NaN last in both directions, then by id."""
    clean = F.when(~F.isnan(F.col(col).cast("double")), F.col(col))
    return [clean.desc_nulls_last() if descending else clean.asc_nulls_last(), F.col("id").asc()]


def decay(value: Column, curve: str, origin: float, scale: float, offset: float = 0, rate: float = 1 / 2) -> Column:
    """Factor from 1 at the origin (and up to ``offset`` from it) down to ``rate`` at ``scale`` beyond; null is 0."""
    if curve not in ("gauss", "exp", "linear"):
        raise QueryError(f"unknown decay {curve!r}")
    if scale <= 0 or offset < 0 or not 0 < rate < 1:
        raise QueryError("decay needs scale > 0, offset >= 0 and 0 < decay < 1")
    d = F.greatest(F.abs(value.cast("double") - F.lit(float(origin))) - F.lit(float(offset)), F.lit(0.0))
    if curve == "gauss":
        f = F.exp(d * d * F.lit(math.log(rate) / (scale * scale)))
    elif curve == "exp":
        f = F.exp(d * F.lit(math.log(rate) / scale))
    else:
        f = F.greatest(1 - d * F.lit((1 - rate) / scale), F.lit(0.0))
    return F.when(value.isNull(), F.lit(0.0)).otherwise(f)


def num_combine(columns: list[Column], mode: str = "sum", weights: list[float] | None = None) -> Column:
    """multiply, sum, max, min, avg or weighted of two columns or more; 0 where any is null, an error where the result isn't finite."""
    if mode not in MODES:
        raise QueryError(f"unknown mode {mode!r}")
    if len(columns) < 2:
        raise QueryError("num_combine needs two columns at least")
    if (mode == "weighted") != (weights is not None) or (weights is not None and (len(weights) != len(columns) or not all(math.isfinite(w) for w in weights))):
        raise QueryError("weights go with mode weighted: a finite one for each column")
    x = [c.cast("double") for c in columns]
    if mode == "multiply":
        v = x[0]
        for c in x[1:]:
            v = v * c
    elif mode in ("max", "min"):
        v = (F.greatest if mode == "max" else F.least)(*x)
    else:
        w = weights or [1.0] * len(x)
        v = x[0] * F.lit(float(w[0]))
        for c, f in zip(x[1:], w[1:]):
            v = v + c * F.lit(float(f))
        if mode == "avg":
            v = v / len(x)
    absent = F.lit(False)
    for c in x:
        absent = absent | c.isNull()
    finite = F.when(F.isnan(v) | F.abs(v).isin(float("inf")), F.raise_error(F.lit("num_combine gave a result that isn't finite")).cast("double")).otherwise(v)
    return F.when(absent, F.lit(0.0)).otherwise(finite)


def round_decimal(value: Column, digits: int) -> Column:
    if not 0 <= digits <= 6:
        raise QueryError("digits lie between 0 and 6")
    return F.round(value.cast("double"), digits)


def random_score(value: Column, seed: int = 0, text: bool = False) -> Column:
    """A stable pseudo-random number in [0, 1) of seed and value; ``text`` for strings."""
    shown = F.concat(F.lit("'"), value, F.lit("'")) if text else value.cast("string")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(shown, F.lit("None"))).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(1 << 64))


def boost(score: Column, metric: str, functions: list[tuple[Column | None, Column | float]], function_mode: str = "multiply", boost_mode: str = "multiply") -> Column:
    """The public score after boosting; ``functions``: (condition or None, weight), applied where the condition holds.

    Boosts act on the engine distance: multiply scales the cosine itself, and the distance of the other metrics; sum brings COSINE, IP and
    BM25 nearer by the value and L2 farther. Rows where no condition holds keep their score.
    """
    return boost_by(score, metric, *boost_value(functions, function_mode), boost_mode)


def boost_by(score: Column, metric: str, any_: Column, value: Column, boost_mode: str = "multiply") -> Column:
    if boost_mode not in ("multiply", "sum"):
        raise QueryError("modes are multiply and sum")
    metrics.check_metric(metric)
    d = metrics.engine_distance(metric, score)
    if boost_mode == "multiply":
        new = 1 - (1 - d) * value if metric == "COSINE" else d * value
    else:
        new = d + value if metric == "L2" else d - value
    return F.when(any_, metrics.from_engine_distance(metric, new)).otherwise(score)


def boost_value(functions: list[tuple[Column | None, Column | float]], function_mode: str = "multiply") -> tuple[Column, Column]:
    """(whether any condition holds, product or sum of the weights of those that hold)."""
    if function_mode not in ("multiply", "sum"):
        raise QueryError("modes are multiply and sum")
    any_, value = F.lit(False), F.lit(1.0 if function_mode == "multiply" else 0.0)
    for cond, weight in functions:
        w = weight if isinstance(weight, Column) else F.lit(float(weight))
        c = F.coalesce(cond, F.lit(False)) if cond is not None else F.lit(True)
        any_ = any_ | c
        step = value * w if function_mode == "multiply" else value + w
        value = F.when(c, step).otherwise(value)
    return any_, value


def group_hits(hits: DataFrame, group: str, limit: int, size: int = 1, scorer: str = "max", offset: int = 0, ascending: bool = False) -> DataFrame:
    """Per qid groups of the best ``size`` hits; groups ordered by max, sum or avg of the scores of these, ``limit`` of them after ``offset``.

    ``ascending``: the smallest score is the best, and max stands for the best one. The hits are computed once.
    """
    if scorer not in SCORERS:
        raise QueryError(f"unknown group scorer {scorer!r}")
    within = hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid", group).orderBy(*sort_key("score", not ascending)))).where(F.col("rank") <= size)
    agg = {"max": F.min if ascending else F.max, "sum": F.sum, "avg": F.avg}[scorer]
    all_ = Window.partitionBy("qid", group).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = F.col("group_score").asc_nulls_last() if ascending else F.col("group_score").desc_nulls_last()
    out = numbered_groups(within.withColumn("group_score", agg("score").over(all_)), [best, F.col("id").asc()], group)
    return out.where((F.col("group_rank") > offset) & (F.col("group_rank") <= offset + limit)).withColumn("group_rank", F.col("group_rank") - offset)
