"""The subspace join against all pairs."""

import numpy as np
import pytest

from orrery.llm import vector_join
from tests.llm import brute


def links(rows, threshold=0.93):
    deg, edges = [0] * len(rows), []
    unit = []
    for _, e, label in rows:
        a = np.array([np.nan if x is None else x for x in e], dtype=float) if e else np.zeros(1)
        unit.append(a / np.sqrt(a @ a) if label is not None and np.isfinite(a).all() and a.any() else None)
    for i in range(len(rows)):
        for j in range(i):
            a, b = unit[i], unit[j]
            if a is not None and b is not None and len(a) == len(b) and rows[i][2] == rows[j][2] and a @ b >= threshold:
                deg[i] += 1
                deg[j] += 1
                edges.append((i, j))
    low = {}
    c = brute.classes(len(rows), edges)
    for r, (v, _, _) in zip(c, rows):
        low[r] = min((x for x in (low.get(r), v) if x is not None), default=None)
    return [(rows[i][0], deg[i], low[r], rows[i][0] == low[r]) for i, r in enumerate(c)]


def key(row):
    return tuple((x is not None, x) for x in row)


def made(dim, n):
    rng = np.random.default_rng(dim)
    centres = rng.standard_normal((6, dim))
    rows = []
    for i in range(n):
        v = centres[i % 6] + rng.standard_normal(dim) * rng.choice([0, 0.1, 0.3, 1.5])
        rows.append((5000 - i, [float(np.float32(x)) for x in v], i % 2))
    return rows


@pytest.mark.parametrize("dim,chunk,kind,saving", [(64, 2048, "double", -9), (64, 7, "float", 1), (64, 7, "float", -9), (5, 16, "double", 0.2), (40, 2048, "float", 1)])
def test_join(spark, monkeypatch, dim, chunk, kind, saving):
    """In strips (a saving of -9 is always reached), whole (1 never is), and by what is counted."""
    monkeypatch.setattr(vector_join, "CHUNK", chunk)
    monkeypatch.setattr(vector_join, "WHOLE_CHUNK", chunk)
    monkeypatch.setattr(vector_join, "SAVING", saving)
    rows = made(dim, 150)
    rows += [rows[3], (1, rows[3][1], rows[3][2]), (2, None, 1), (3, [], 1), (4, [0.0] * dim, 1), (5, [float("nan")] * dim, 1), (6, [None] * dim, 1), (7, rows[0][1], None), (None, rows[0][1], rows[0][2]), (8, rows[0][1][:-1], rows[0][2]), (9, [x * 3 for x in rows[0][1]], rows[0][2])]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], f"vec_id long, embedding array<{kind}>, label int, copies int, key string").repartition(3)
    got = sorted(map(tuple, vector_join.near_vectors(df).collect()), key=key)
    assert got == sorted(links(rows), key=key)
    assert max(r[1] for r in got) > 5


def test_tight_clusters(spark):
    """Most pairs of a strip are near: the matrix way, with vectors on both sides of the threshold."""
    rng = np.random.default_rng(8)
    c = rng.standard_normal((2, 32))
    rows = [(i, (c[i % 2] + rng.standard_normal(32) * (0.24 if i % 5 else 0.31)).tolist(), 4) for i in range(160)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1)
    want = links(rows)
    assert sorted(map(tuple, vector_join.near_vectors(df).collect())) == sorted(want)
    assert len({r[1] for r in want}) > 5 and min(r[1] for r in want) < 60 < max(r[1] for r in want)


def test_forest():
    rng = np.random.default_rng(2)
    for p in (0.02, 0.1, 0.5, 0.9):
        link = rng.random((30, 40)) < p
        i, j = np.nonzero(link)
        u, v = vector_join._forest(link)
        assert link[u, v].all()
        want, got = (brute.classes(70, list(zip(x.tolist(), (y + 30).tolist()))) for x, y in ((i, j), (u, v)))
        assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_empty_and_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert vector_join.near_vectors(df.limit(0)).count() == 0
    rows = [tuple(r) for r in df.select("vec_id", "embedding", "label").limit(200).collect()]
    part = spark.createDataFrame(rows, df.select("vec_id", "embedding", "label").schema)
    assert sorted(map(tuple, vector_join.near_vectors(part).collect())) == sorted(links(rows))
