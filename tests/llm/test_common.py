"""Shared pieces: skewed lookups, components both ways, the columnar shuffle."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import common
from tests.llm import brute


@pytest.mark.parametrize("limit", [0, 1000])
def test_components(spark, limit):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    roots = brute.classes(len(nodes), [(at[a], at[b]) for a, b in edges if a != b])
    low = {}
    for x, r in zip(nodes, roots):
        low[r] = min(low.get(r, x), x)
    assert {r.node: r.component for r in common.components(df, limit).collect()} == {x: low[r] for x, r in zip(nodes, roots)}
    assert common.components(df.limit(0), limit).count() == 0


def test_lookup_with_a_hot_key(spark):
    left = spark.range(40_000).select("id", F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 1000 == 1, F.lit(None)).otherwise(F.col("id") % 501).cast("long").alias("k"))
    right = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner"):
        got = sorted(map(str, common.lookup(left, right, "k", how).select("id", "k", "v").collect()))
        assert got == sorted(map(str, left.join(right, "k", how).select("id", "k", "v").collect()))


def test_scatter():
    kind = np.dtype([("h", "<u8"), ("x", "<i4")])
    rng = np.random.default_rng(1)
    r = np.zeros(5000, dtype=kind)
    r["h"], r["x"] = rng.integers(0, 1 << 63, 5000), np.arange(5000)
    s = common.Scatter(7, flush=20_000)
    out = [b for i in range(0, 5000, 500) for b in s.add(r[i : i + 500])] + list(s.out())
    parts = [(b.column(0)[i].as_py(), common.records(b.column(1).slice(i, 1), kind)) for b in out for i in range(b.num_rows)]
    assert sorted(x for _, p in parts for x in p["x"].tolist()) == list(range(5000))
    home = {}
    for bucket, p in parts:
        for h in p["h"].tolist():
            assert home.setdefault(h, bucket) == bucket
