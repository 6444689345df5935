"""Every registered query against its SQL on the smallest tables, and the approximate indexes' recall."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from orrery import queries
from orrery.operators import ann
from orrery.operators.knn import knn, knn_matrix

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in os.listdir(SF):
        c.sql(f"CREATE VIEW {p.split('.')[0]} AS SELECT * FROM '{SF}/{p}{'' if os.path.isfile(f'{SF}/{p}') else '/*.parquet'}'")
    return c


def norm(v):
    if isinstance(v, list | tuple):
        return [norm(x) for x in v]
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted([norm(r[c]) for c in cols] for r in df.collect())
    rel = con.sql(queries.SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted([norm(r[i]) for i in at] for r in rel.fetchall())


@pytest.mark.parametrize("way", ["L2", "COSINE"])
def test_recall(spark, way):
    metric = way
    v, q = queries.vectors(spark, SF).cache(), queries.probes(spark, SF)
    exact = knn(v, q, metric, 10).select("qid", "id", "score")
    assert sorted(map(tuple, knn_matrix(v, q, metric, 10).select("qid", "id").collect())) == sorted(map(tuple, exact.select("qid", "id").collect()))
    for sq8 in (False, True):
        assert ann.recall(ann.search_ivf(ann.build_ivf(v, metric, sq8=sq8), q, 10), exact) >= 0.9
    bits = ann.fit_lsh(v, metric, 64)
    assert ann.recall(ann.search_lsh(ann.build_lsh(v, ann.TABLES, bits, dim=64), q, metric, 10, 64, ann.TABLES, bits), exact) >= 0.9


def test_effort_follows_the_vectors(spark):
    """Vectors in clusters need few lists and long codes."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 16)) * 4
    rows = [(i, (centres[i % 40] + rng.standard_normal(16) * 0.2).tolist()) for i in range(2000)]
    v = spark.createDataFrame(rows, "id long, vector array<double>").cache()
    q = v.where("id % 50 = 0").selectExpr("id AS qid", "vector AS qvector")
    exact = knn(v, q, "L2", 10)
    index = ann.build_ivf(v, "L2")
    assert index.nprobe <= 0.1 * len(index.centroids) and ann.recall(ann.search_ivf(index, q, 10), exact) >= 0.9
    bits = ann.fit_lsh(v, "L2", 16)
    assert bits >= 7 and ann.recall(ann.search_lsh(ann.build_lsh(v, ann.TABLES, bits, dim=16), q, "L2", 10, 16, ann.TABLES, bits), exact) >= 0.9


def test_queries_in_groups(spark, monkeypatch):
    from orrery.operators import knn as module

    v, q = queries.vectors(spark, SF), queries.probes(spark, SF)
    whole = sorted(map(tuple, knn(v, q, "COSINE", 3).select("qid", "id").collect()))
    monkeypatch.setattr(module, "BROADCAST_COMPONENTS", 200)
    assert len(module.broadcastable(q)) > 1
    assert sorted(map(tuple, knn(v, q, "COSINE", 3).select("qid", "id").collect())) == whole


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
