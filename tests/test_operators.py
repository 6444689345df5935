"""Fusion, reranking, grouping and time functions against plain Python."""

import hashlib
import math
from collections import defaultdict
from datetime import UTC, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.errors import QueryError, SchemaError
from orrery.functions import geometry, metrics, temporal, text
from orrery.operators import fusion
from orrery.operators.knn import grouped_top_k, top_k
from orrery.plans.chain import Chain, from_spec

A = [(0, 1, 0.9, "x"), (0, 2, 0.5, "y"), (0, 3, 0.5, "x"), (1, 9, 0.1, None)]
B = [(0, 3, 2.0, "late"), (0, 1, 5.0, "late"), (0, 7, 9.0, "z")]


@pytest.fixture(scope="module")
def routes(spark):
    schema = "qid long, id long, score double, kind string"
    return [(spark.createDataFrame(A, schema), "COSINE"), (spark.createDataFrame(B, schema), "L2")]


def relevance(metric, s):
    return {"COSINE": (1 + s) / 2, "IP": 0.5 + math.atan(s) / math.pi, "L2": 1 - 2 * math.atan(s) / math.pi, "BM25": 2 * math.atan(s) / math.pi}[metric]


def expected(how, weights=(0.5, 0.25)):
    parts = defaultdict(list)
    for i, (rows, metric) in enumerate(((A, "COSINE"), (B, "L2"))):
        by = defaultdict(list)
        for q, d, s, _ in rows:
            by[q].append((s if metric == "L2" else -s, d, s))
        for q, hits in by.items():
            for rank, (_, d, s) in enumerate(sorted(hits), 1):
                v = {"rrf": 1 / (60 + rank), "weighted": weights[i] * relevance(metric, s)}.get(how, relevance("L2", s) if metric == "L2" else s)
                parts[q, d].append(v)
    f = {"max": max, "avg": lambda x: sum(x) / len(x)}.get(how, sum)
    return {k: round(f(v), 9) for k, v in parts.items()}


@pytest.mark.parametrize("how", ["rrf", "weighted", "max", "sum", "avg"])
def test_merge(routes, how):
    got = fusion.merge(routes, how, weights=[0.5, 0.25] if how == "weighted" else None).collect()
    assert {(r.qid, r.id): round(r.score, 9) for r in got} == expected(how)
    assert {(r.qid, r.id): r.kind for r in got}[0, 3] == "x"  # the first route's


def test_merge_of_distances_alone(routes):
    got = fusion.merge([routes[1], routes[1]], "avg").collect()
    assert {r.id: r.score for r in got} == {3: 2.0, 1: 5.0, 7: 9.0}
    assert fusion.merged_ascending(["L2", "L2"], "avg") and not fusion.merged_ascending(["L2", "IP"], "avg")


@pytest.mark.parametrize("call", [lambda r: fusion.merge([], "rrf"), lambda r: fusion.merge(r, "rrf", k=0), lambda r: fusion.merge(r, "weighted", weights=[0.1]), lambda r: fusion.merge(r, "weighted", weights=[0.1, 2]), lambda r: fusion.merge(r, "median"), lambda r: top_k(r[0][0], [F.col("score")], 0), lambda r: fusion.num_combine([F.lit(1)]), lambda r: fusion.num_combine([F.lit(1), F.lit(2)], "sum", [1, 2]), lambda r: fusion.decay(F.lit(1), "gauss", 0, 0), lambda r: fusion.round_decimal(F.lit(1), 7), lambda r: metrics.check_metric("cosine")])
def test_bad_arguments(routes, call):
    with pytest.raises(QueryError):
        call(routes)


def test_groups(spark):
    rows = [(0, i, float(s), g) for i, (s, g) in enumerate([(9, "a"), (8, None), (7, "b"), (6, "b"), (5, "a"), (4, "c"), (3, None)])]
    hits = spark.createDataFrame(rows, "qid long, id long, score double, g string")
    by = [F.col("score").desc(), F.col("id")]
    got = {(r.group_rank, r["rank"]): r.id for r in grouped_top_k(hits, by, "g", 2, 2, offset=1).collect()}
    assert got == {(1, 1): 1, (1, 2): 6, (2, 1): 2, (2, 2): 3}
    strict = {(r.group_rank, r["rank"]): r.id for r in grouped_top_k(hits, by, "g", 9, 2, strict=True).collect()}
    assert {i for i in strict.values()} == {0, 4, 1, 6, 2, 3}
    summed = fusion.group_hits(hits, "g", 2, 2, "sum").collect()
    assert {(r.group_rank, r.id): r.group_score for r in summed} == {(1, 0): 14.0, (1, 4): 14.0, (2, 2): 13.0, (2, 3): 13.0}


@settings(max_examples=12, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-50, 50)), min_size=1, max_size=6), st.sampled_from(["gauss", "exp", "linear"]), st.floats(-9, 9), st.floats(0.1, 9), st.floats(0, 3), st.floats(0.05, 0.95))
def test_decay(spark, values, kind, origin, scale, offset, rate):
    def one(v):
        if v is None:
            return 0.0
        d = max(0.0, abs(v - origin) - offset)
        return {"gauss": math.exp(d * d * math.log(rate) / scale**2), "exp": math.exp(d * math.log(rate) / scale), "linear": max(0.0, 1 - d * (1 - rate) / scale)}[kind]

    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(fusion.decay(F.col("v"), kind, origin, scale, offset, rate)).collect()]
    assert got == pytest.approx([one(v) for v in values], abs=1e-12)


def test_boost_and_random(spark):
    df = spark.createDataFrame([(1, 0.8, "k1"), (2, 0.5, "k'2"), (3, 4.0, None)], "id long, s double, name string")
    r = df.select("id", fusion.random_score(F.col("id"), 5).alias("n"), fusion.random_score(F.col("name"), 5, text=True).alias("t"), fusion.boost(F.col("s"), "COSINE", [(F.col("id") < 3, 2.0), (F.col("id") == 1, 3.0)]).alias("m"), fusion.boost(F.col("s"), "IP", [(None, 2.0)], boost_mode="sum").alias("p"), fusion.boost(F.col("s"), "L2", [(F.col("id") == 3, 0.5)]).alias("l")).collect()

    def rand(v):
        return int.from_bytes(hashlib.sha256(f"5:{v!r}".encode()).digest()[:8], "big") / 2**64

    assert [x.n for x in r] == [rand(1), rand(2), rand(3)] and r[0].t == rand("k1") and r[2].t == rand(None)
    assert [round(x.m, 9) for x in r] == [4.8, 1.0, 4.0] and [x.p for x in r] == [2.8, 2.5, 6.0]
    assert [round(x.l, 9) for x in r] == [0.8, 0.5, 1.0]


def test_num_combine_and_sort(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, None, 3.0), (3, float("nan"), 1.0)], "id long, a double, b double")
    some = df.where("id < 3")
    for mode, want in (("multiply", 6.0), ("sum", 5.0), ("max", 3.0), ("min", 2.0), ("avg", 2.5)):
        assert [r[0] for r in some.select(fusion.num_combine([F.col("a"), F.col("b")], mode)).collect()] == [want, 0.0]
    with pytest.raises(Exception, match="finite"):
        df.select(fusion.num_combine([F.col("a"), F.col("b")])).collect()
    assert [r.id for r in df.orderBy(*fusion.sort_key("a")).collect()] == [1, 2, 3]
    assert [r.id for r in df.orderBy(*fusion.sort_key("a", False)).collect()] == [1, 2, 3]


@pytest.mark.parametrize("spec", [[], [{"op": "map", "expr": "nope", "inputs": ["$score"], "output": "x"}], [{"op": "map", "expr": "round_decimal", "params": {"decimal": 2}, "inputs": ["gone"], "output": "x"}], [{"op": "sort", "by": "gone"}], [{"op": "limit", "limit": 1}, {"op": "limit", "limit": 1}], [{"op": "merge"}], [{"op": "map", "expr": "decay", "params": {"function": "gauss", "origin": 1, "scale": 1, "wide": 2}, "inputs": ["$score"], "output": "x"}]])
def test_bad_chains(spark, spec):
    with pytest.raises(QueryError):
        from_spec(spec, ["qid", "id", "score"])


def test_fluent_chain(spark):
    hits = spark.createDataFrame([(0, i, i / 10, i % 3) for i in range(9)], "qid long, id long, score double, g long")
    out = Chain().map("$score", lambda s, w: s * w, "$score", -1.0).sort("$score").limit(3, 1).select("$id", "$score").execute(hits)
    assert sorted(r.id for r in out.collect()) == [1, 2, 3] and out.columns == ["qid", "id", "score"]
    assert Chain().group_by("g", 1, 2).execute(hits).count() == 2


def test_time():
    assert temporal.parse_interval("P1DT2.5H").total_seconds() == 86400 + 9000 and temporal.parse_interval("P0D").total_seconds() == 0
    for bad in ("P", "P1Y", "1D", "PT", "P0W"):
        with pytest.raises(SchemaError):
            temporal.parse_interval(bad)
    t = datetime(2024, 5, 6, 7, 8, 9, tzinfo=UTC)
    assert temporal.parse_timestamp("2024-05-06T09:08:09", "Europe/Berlin") == t == temporal.parse_timestamp(int(t.timestamp()) * 1_000_000) == temporal.parse_timestamp("2024-05-06T07:08:09Z")
    for bad in (True, "2024-05-06T09:08:09", "x", 1.5):
        with pytest.raises(SchemaError):
            temporal.parse_timestamp(bad)


def test_geometry():
    p = geometry.parse_wkt
    square, inner, apart = p("POLYGON((0 0, 0 4, 4 4, 4 0, 0 0))"), p("polygon ((1 1, 2 1, 2 2, 1 1))"), p("POLYGON((9 9, 10 9, 10 10, 9 9))")
    assert geometry.contains(square, inner) and geometry.within(inner, square) and not geometry.contains(inner, square)
    assert geometry.intersects(square, inner) and not geometry.intersects(square, apart)
    assert geometry.distance(square, apart) == pytest.approx(math.hypot(5, 5)) and geometry.distance(p("POINT(2 7)"), square) == 3
    assert geometry.contains(square, p("POINT(4 4)")) and geometry.contains(p("POINT(1 1)"), p("POINT(1 1)")) and not geometry.contains(p("POINT(1 1)"), square)
    for bad in ("POINT(1)", "POINT(1 x)", "POINT(1 inf)", "LINESTRING(0 0, 1 1)", "POLYGON((0 0, 1 1, 0 0))", "POLYGON((0 0, 2 2, 2 0, 0 2, 0 0))", "POLYGON((0 0, 1 0, 1 1, 0 1))", None, 3):
        assert not geometry.valid(bad)


def test_terms(spark):
    df = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (4, "É_1 été É_1")], "id long, t string")
    got = {r.id: r.m for r in df.select("id", text.term_counts(text.tokens(F.col("t"))).alias("m")).collect()}
    assert got == {1: {"a": 1, "b": 2}, 2: {}, 3: {}, 4: {"é_1": 2, "été": 1}}
    with pytest.raises(SchemaError):
        text.analyzer({"tokenizer": "nope"})
    with pytest.raises(SchemaError):
        text.analyzer({"filter": [{"type": "lower"}]})
