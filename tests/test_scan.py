"""The search by blocks against plain column expressions: the same hits, ties and bits, in bounded memory."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery import queries
from orrery.operators import ann, fusion, knn as knn_module, scan
from orrery.operators.knn import grouped_top_k, knn, order, scored, top_k
from orrery.operators.scan import Range, Weight, best_pairs
from orrery.schema import CollectionSpec, FieldSpec
from orrery.sources.catalog import Catalog

ROWS = "id long, label int, vector array<float>"


@pytest.fixture(scope="module")
def odd(spark):
    """Vectors that repeat, lie in clusters, are zero, huge, tiny, null, of another length or not finite."""
    rng = np.random.default_rng(5)
    plain = rng.standard_normal((300, 6)).astype(np.float32)
    vectors = [*plain, *plain[:120], *(plain[:60] * 3), *np.repeat(plain[7:9], 40, axis=0)]
    vectors = [v.tolist() for v in vectors]
    vectors += [[0.0] * 6, [0.0] * 6, [1e30] * 6, [1e-30] * 6, None, [1.0] * 5, [float("nan"), *[1.0] * 5], [float("inf"), *[1.0] * 5], [-1e38] * 6]
    ids = rng.permutation(len(vectors)).tolist()
    return spark.createDataFrame([(i, None if i % 11 == 0 else i % 4, v) for i, v in zip(ids, vectors)], ROWS).repartition(5).cache()


@pytest.fixture(scope="module")
def asked(odd):
    return odd.where("id % 9 = 0 OR vector[0] = 0").selectExpr("id AS qid", "vector AS qvector")


def bits(df, *cols):
    """Rows with the bits of their scores."""
    return sorted(tuple(x.hex() if isinstance(x, float) else x for x in r) for r in df.select("qid", "id", "score", *cols).collect())


@pytest.mark.parametrize("metric", ["COSINE", "IP", "L2"])
def test_top_k(odd, asked, metric):
    assert bits(knn(odd, asked, metric, 7, offset=2), "rank", "label") == bits(top_k(scored(odd, asked, metric), order(metric), 7, 2), "rank", "label")
    all_ = bits(top_k(scored(odd, asked, metric), order(metric), 1000), "rank")
    assert bits(knn(odd, asked, metric, 1000), "rank") == all_


@pytest.mark.parametrize(("metric", "radius", "most"), [("COSINE", 0.1, 0.8), ("COSINE", None, 0.5), ("IP", 0.5, None), ("L2", 4.0, 0.5), ("L2", None, 1.0)])
def test_ranges(odd, asked, metric, radius, most):
    hits = scored(odd, asked, metric).where(knn_module.metrics.in_range(metric, F.col("score"), radius, most))
    assert bits(knn(odd, asked, metric, 9, radius=radius, range_filter=most), "rank") == bits(top_k(hits, order(metric), 9), "rank")


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("most", [1000, 2])
def test_groups(odd, asked, strict, most, monkeypatch):
    """Few groups in the blocks, many as pairs."""
    monkeypatch.setattr(knn_module, "MOST_GROUPS", most)
    plain = grouped_top_k(scored(odd, asked, "COSINE"), order("COSINE"), "label", 3, 4, strict, 1)
    assert bits(knn(odd, asked, "COSINE", 3, group_by="label", group_size=4, strict=strict, offset=1), "rank", "group_rank") == bits(plain, "rank", "group_rank")


@pytest.mark.parametrize("metric", ["COSINE", "IP", "L2"])
@pytest.mark.parametrize("boost_mode", ["multiply", "sum"])
def test_weights(odd, asked, metric, boost_mode):
    functions = [(F.col("label") == 1, 0.0), (F.col("label") > 1, -1.5), (F.col("id") % 5 == 0, 2.5)]
    any_, value = fusion.boost_value(functions)
    score = fusion.boost(F.col("score"), metric, functions, boost_mode=boost_mode)
    finite = odd.where("NOT isnan(vector[0]) AND abs(vector[0]) < 1e20")
    hits = best_pairs(finite, asked, metric, 6, carry=["label"], weight=Weight(boost_mode, value, any_))
    assert bits(top_k(hits.withColumn("score", score), order(metric), 6), "rank") == bits(top_k(scored(finite, asked, metric).withColumn("score", score), order(metric), 6), "rank")


def test_queries_in_groups(odd, asked, monkeypatch):
    whole = bits(knn(odd, asked, "L2", 5), "rank")
    monkeypatch.setattr(scan, "POOL", 40)
    assert bits(knn(odd, asked, "L2", 5), "rank") == whole


def test_other_scores(odd, asked):
    got = {(r.qid, r.id): (r.score_ip, r.score_l2) for r in knn(odd, asked, "COSINE", 4, also=("IP", "L2")).collect()}
    for m, at in (("IP", 0), ("L2", 1)):
        plain = {(r.qid, r.id): r.score for r in scored(odd, asked, m).collect()}
        assert all(repr(v[at]) == repr(plain[key]) for key, v in got.items())


def test_text_keys_and_no_queries(odd, asked):
    rows = odd.withColumn("id", F.concat(F.lit("k"), "id"))
    assert bits(knn(rows, asked, "L2", 5), "rank") == bits(top_k(scored(rows, asked, "L2"), order("L2"), 5), "rank")
    assert knn(odd, asked.limit(0), "L2", 5).count() == 0 and knn(odd.limit(0), asked, "L2", 5).count() == 0


def test_what_a_task_keeps(monkeypatch):
    """A task keeps and sends k hits of each query, whatever the number of rows and of equal vectors, and scores few pairs one by one."""
    monkeypatch.setattr(scan, "TILE", 64)
    rng = np.random.default_rng(1)
    v = rng.standard_normal((20_000, 8)).astype(np.float32)
    v[5_000:10_000] = v[0]
    q = v[:50].astype(np.float64)
    plan = scan._Plan("COSINE", 10, pa.array(np.arange(50)), {8: (np.arange(50), q)})
    best, seen = scan._Best(plan), []
    monkeypatch.setattr(scan, "exact", lambda *a, plain=scan.exact: seen.append(len(a[3])) or plain(*a))
    for at in range(0, len(v), 2_000):
        part = v[at : at + 2_000]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * 8), pa.array(part.ravel()))
        best.add(pa.record_batch([lists, pa.array(np.arange(at, at + len(part)))], names=["_vector", "id"]))
        assert best.stored <= 200_000
    got = pa.Table.from_batches(list(best.result()))
    assert got.num_rows == 500 and sum(seen) < 0.25 * 50 * len(v)
    s = v.astype(np.float64) @ q.T / np.outer(np.linalg.norm(v.astype(np.float64), axis=1), np.linalg.norm(q, axis=1))
    want = {(j, i) for j in range(50) for i in np.lexsort((np.arange(len(v)), -np.round(s[:, j], 9)))[:10]}
    assert {(a, b) for a, b in zip(got["qid"].to_pylist(), got["id"].to_pylist())} == want


def test_hits_are_computed_once(spark, odd, asked):
    """Groups are ranked on the hits, not joined with a second run of the search that found them."""
    hits = knn(odd, asked, "COSINE", 20).select("qid", "id", "score", "label")
    for df in (fusion.group_hits(hits, "label", 3, 2, "sum"), knn(odd, asked, "COSINE", 3, group_by="label", group_size=2)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_range_of_nan():
    assert Range(low=0.5).holds(np.array([np.nan, 0.5, 0.6, math.inf])).tolist() == [True, False, True, True]
    assert Range(high=0.5, high_closed=True).holds(np.array([np.nan, 0.5, 0.6])).tolist() == [False, True, False]


@pytest.mark.parametrize("metric", ["COSINE", "L2"])
@pytest.mark.parametrize("bits_", [1, 3, 9])
def test_buckets(odd, asked, metric, bits_):
    """Rows that share a bucket with a query, found without a pair of keys being written."""
    v = odd.where("size(vector) = 6 AND NOT isnan(vector[0])")
    index = ann.build_lsh(v, 3, bits_, dim=6)
    hashed = ann.build_lsh(asked.where("size(qvector) = 6 AND NOT isnan(qvector[0])").selectExpr("qid AS id", "qvector AS vector"), 3, bits_, dim=6).select(F.col("id").alias("qid"), F.explode("buckets").alias("b"))
    met = index.select("id", F.explode("buckets").alias("b")).join(hashed, "b").select("qid", "id").distinct()
    plain = top_k(scored(v, asked, metric).join(met, ["qid", "id"]), order(metric), 8)
    found = ann.search_lsh(index, asked.where("NOT isnan(qvector[0])"), metric, 8, 6, 3, bits_)
    assert bits(found, "rank") == bits(plain, "rank")
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_lists(spark, odd, asked, tmp_path):
    """Rows of the probed lists; a list is one file, and lists that no query looks into aren't read."""
    v = odd.where("size(vector) = 6 AND abs(vector[0]) < 1e20").repartition(8)
    q = asked.where("size(qvector) = 6 AND abs(qvector[0]) < 1e20")
    index = ann.build_ivf(v, "L2", 10)
    index.write(str(tmp_path / "rows"))
    assert all(len(list(f.glob("*.parquet"))) == 1 for f in (tmp_path / "rows").glob("list=*"))
    index.rows = spark.read.parquet(str(tmp_path / "rows"))
    got = bits(ann.search_ivf(index, q, 6, nprobe=3), "rank")
    c = index.centroids
    near = [(r.qid, int(n)) for r in q.collect() for n in np.argsort((c * c).sum(1) - 2 * c @ np.array(r.qvector, dtype=np.float64), kind="stable")[:3]]
    probed = spark.createDataFrame(near, "qid long, list int")
    assert got == bits(top_k(scored(index.rows, q, "L2").join(probed, ["qid", "list"]), order("L2"), 6), "rank")
    one = ann.search_ivf(index, q.limit(1), 6, nprobe=1)
    assert re.search(r"PartitionFilters: \[.*list#\d+ = ", one._jdf.queryExecution().executedPlan().toString())


def test_next_page(odd, asked):
    """Hits below a score, that score left out; one pass that keeps a page of each query."""
    at = scored(odd, asked, "COSINE").where("score < 0.9").agg(F.max("score")).first()[0]
    hits = best_pairs(odd, asked, "COSINE", 5, within=Range(high=at))
    plain = top_k(scored(odd, asked, "COSINE").where(F.col("score") < at), order("COSINE"), 5)
    assert bits(top_k(hits, order("COSINE"), 5), "rank") == bits(plain, "rank")
    assert hits.count() <= 5 * 12 * asked.count()


def test_collection(spark, odd, asked, tmp_path):
    """Searches of a collection: the same hits as all pairs give, with fields, boosts and groups, and none of them lists all pairs."""
    spec = CollectionSpec((FieldSpec("key", "VARCHAR", primary=True), FieldSpec("label", "INT32", nullable=True), FieldSpec("tag", "VARCHAR"), FieldSpec("v", "FLOAT_VECTOR", dim=6)), dynamic=True)
    c = Catalog(spark, str(tmp_path)).create_collection("c", spec)
    v = odd.where("size(vector) = 6 AND abs(vector[0]) < 1e20")
    c.insert(v.select(F.concat(F.lit("k"), "id").alias("key"), "label", F.concat(F.lit("t"), F.col("id") % 3).alias("tag"), F.col("vector").alias("v"), (F.col("id") % 2).alias("half")))
    c.delete_where("label == 3")
    q = asked.where("size(qvector) = 6 AND abs(qvector[0]) < 1e20")
    ranker = {"functions": [{"params": {"filter": "tag == 't1'", "weight": 0.5}}]}
    functions = [(F.col("tag") == "t1", 0.5)]
    pairs = scored(c.live(), q, "L2", "v").withColumn("id", F.col("key"))
    shown = ("qid", "id", "distance", "rank", "tag", "label")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    of = lambda df: rows(df.withColumnRenamed("score", "distance").select(*shown))
    found = c.search(q, 4, "L2", offset=1, output_fields=["tag", "label"])
    assert rows(found.select(*shown)) == of(top_k(pairs, order("L2"), 4, 1))
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    boosted = pairs.withColumn("score", fusion.boost(F.col("score"), "L2", functions))
    assert rows(c.search(q, 4, "L2", ranker=ranker, output_fields=["tag", "label"]).select(*shown)) == of(top_k(boosted, order("L2"), 4))
    in_range = boosted.where(knn_module.metrics.in_range("L2", F.col("score"), 3.0, 0.1))
    assert rows(c.search(q, 4, "L2", ranker=ranker, radius=3.0, range_filter=0.1, output_fields=["tag", "label"]).select(*shown)) == of(top_k(in_range, order("L2"), 4))
    assert rows(c.search(q, 2, "L2", group_by="label", group_size=2, output_fields=["tag", "label"]).select(*shown)) == of(grouped_top_k(pairs, order("L2"), "label", 2, 2))
    halves = c.search(q, 3, "L2", output_fields=["half"]).collect()
    assert all(int(r.half) == int(r.id[1:]) % 2 for r in halves)
    both = [{"queries": q, "limit": 5, "metric": m} for m in ("L2", "COSINE")]
    fused = c.hybrid_search(both, "rrf", 3, output_fields=["tag", "v"])
    merged = fusion.merge([(top_k(scored(c.live(), q, m, "v").withColumn("id", F.col("key")), order(m), 5).select("qid", "id", "score"), m) for m in ("L2", "COSINE")], "rrf")
    assert rows(fused.select("qid", "id", "score", "rank")) == rows(top_k(merged, fusion.sort_key("score"), 3).select("qid", "id", "score", "rank"))
    own = {r.key: (r.tag, r.v) for r in c.live().collect()}
    assert all((r.tag, r.v) == own[r.id] for r in fused.collect())
    assert "NestedLoop" not in fused._jdf.queryExecution().executedPlan().toString()


def test_order_of_the_rows_alone(spark):
    """Where no score takes part in the order, the first rows are taken before they meet the queries."""
    plan = queries.QUERIES["chain_builder"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join")
    assert plan.index("rank", join) > join and "WindowGroupLimit" in plan[join:]
