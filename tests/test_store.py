"""Collections, catalog and streams end to end."""

import random

import pytest
from pyspark.sql import functions as F

from orrery.errors import AlreadyExistsError, NotFoundError, QueryError, SchemaError, StateError
from orrery.schema import CollectionSpec, FieldSpec, FunctionSpec
from orrery.sources.catalog import Catalog
from orrery.sources.store import Collection
from orrery.streaming import apply_mutations, latest_state

SPEC = CollectionSpec(
    (
        FieldSpec("id", "INT64", primary=True),
        FieldSpec("title", "VARCHAR", nullable=True, max_length=8),
        FieldSpec("rank", "INT32", default=7),
        FieldSpec("tenant", "VARCHAR", nullable=True),
        FieldSpec("spot", "FLOAT_VECTOR", dim=2),
    ),
    dynamic=True,
)


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, tmp_path / "db")


def ids(df):
    return sorted(r.id for r in df.collect())


def row(i, **more):
    return {"id": i, "spot": [float(i), 1.0], **more}


def test_write_and_read(catalog):
    c = catalog.create_collection("things", SPEC)
    assert c.insert([row(1, title="one", color="red"), row(2, title="two"), row(3)]) == 3
    assert c.insert([row(2, title="zwei", rank=9)]) == 1
    got = {r.id: r for r in c.query(output_fields=["*"]).collect()}
    assert got[2].title == "zwei" and got[2]["rank"] == 9 and got[1]["rank"] == 7 and got[3].title is None
    assert ids(c.query('color == "red"')) == [1]
    assert c.query(output_fields=["color"]).orderBy("id").collect()[0].color == "red"
    assert [r.id for r in c.get([3, 9, 1, 3]).collect()] == [3, 1, 3]
    assert c.query("id > 1", ["count(*)"]).first()[0] == 2
    assert [r.id for r in c.query(limit=1, offset=1).collect()] == [2]
    assert c.delete([1]) == 1 and ids(c.query()) == [2, 3]
    assert c.insert([row(1)]) == 1 and c.num_entities() == 3
    assert c.delete_where("rank == 9") == 1 and ids(c.query()) == [1, 3]
    assert c.upsert([{"id": 3, "title": "drei"}, {"id": 1, "title": None, "spot": [5.0, 5.0]}]) == 2
    got = {r.id: r for r in c.query().collect()}
    assert got[3].title == "drei" and list(got[3].spot) == [3.0, 1.0] and got[1].title is None and list(got[1].spot) == [5.0, 5.0]
    assert [ids(p) for p in c.query_iterator(batch=1)] == [[1], [3]]


@pytest.mark.parametrize(
    "bad",
    [
        {"id": 1},
        {"id": None, "spot": [1.0, 2.0]},
        {"id": 1, "spot": [1.0]},
        {"id": 1, "spot": [1.0, 2.0], "title": "much too long"},
        {"id": "x", "spot": [1.0, 2.0]},
        {"id": 1, "spot": [1.0, 2.0], "rank": 1 << 40},
    ],
)
def test_bad_records_write_nothing(catalog, bad):
    c = catalog.create_collection("strict", SPEC)
    with pytest.raises((SchemaError, TypeError)):
        c.insert([row(5), bad])
    assert c.num_entities() == 0 and c.state["next_seq"] == 1


def test_order_of_mutations_does_not_matter(spark):
    from orrery.operators.live import live_rows

    rng = random.Random(4)
    log = [(rng.randrange(20), s, rng.random() < 0.3) for s in range(1, 200)]
    want = {}
    for k, s, gone in log:
        want[k] = None if gone else s
    for seed in (1, 2):
        mixed = log[:]
        random.Random(seed).shuffle(mixed)
        data = spark.createDataFrame([(k, s, "_default") for k, s, g in mixed if not g], "id long, _seq long, _partition string")
        gone = spark.createDataFrame([(k, s) for k, s, g in mixed if g], "id long, _seq long")
        got = {r.id: r._seq for r in live_rows(data, gone, "id").collect()}
        assert got == {k: s for k, s in want.items() if s is not None}


def test_partitions_compaction_snapshots(catalog):
    c = catalog.create_collection("parts", SPEC)
    c.create_partition("p")
    with pytest.raises(AlreadyExistsError):
        c.create_partition("p")
    c.insert([row(1), row(2)])
    c.insert([row(2, title="in p"), row(3)], "p")
    assert c.num_entities() == 3 and c.num_entities("_default") == 2 and c.num_entities("p") == 2
    c.create_snapshot("before")
    c.delete([3])
    c.insert([row(4)])
    c.compact()
    assert ids(c.query()) == [1, 2, 4] and c.data().count() == 3 and c.deletes().count() == 0
    old = catalog.restore_snapshot("parts", "before", "again")
    assert ids(old.query()) == [1, 2, 3] and old.insert([row(9)]) == 1 and old.num_entities() == 4
    c.drop_snapshot("before")
    assert c.list_snapshots() == []
    c.drop_partition("p")
    assert ids(c.query()) == [1, 4]
    with pytest.raises(StateError):
        c.drop_partition("_default")
    c.delete([1])
    c.insert([row(7)])
    c.collect_tombstones()
    assert ids(c.query()) == [4, 7]
    c.truncate()
    assert c.num_entities() == 0
    keyed = CollectionSpec((FieldSpec("id", "INT64", primary=True, auto_id=True), FieldSpec("tenant", "VARCHAR", partition_key=True, nullable=True), FieldSpec("spot", "FLOAT_VECTOR", dim=2)))
    k = catalog.create_collection("keyed", keyed)
    k.insert([{"tenant": t, "spot": [1.0, 2.0]} for t in ("a", "b", None)])
    import hashlib

    want = {t: f"_pk_{int(hashlib.md5(str(t).encode()).hexdigest(), 16) % 16}" for t in ("a", "b", None)}
    assert {r.tenant: r._partition for r in k.live().collect()} == want and ids(k.query()) == [1, 2, 3]
    with pytest.raises(StateError):
        k.create_partition("x")


def test_search(catalog):
    text = CollectionSpec(
        (FieldSpec("id", "INT64", primary=True), FieldSpec("body", "VARCHAR", analyzer={}, nullable=True), FieldSpec("kind", "VARCHAR"), FieldSpec("spot", "FLOAT_VECTOR", dim=2, nullable=True), FieldSpec("terms", "SPARSE_FLOAT_VECTOR", nullable=True), FieldSpec("emb", "FLOAT_VECTOR", dim=8)),
        (FunctionSpec("f", "BM25", "body", "terms"), FunctionSpec("g", "TEXT_EMBEDDING", "body", "emb")),
    )
    c = catalog.create_collection("texts", text)
    c.insert([{"id": 1, "body": "red fox", "kind": "a", "spot": [1.0, 0.0]}, {"id": 2, "body": "red red wine", "kind": "a", "spot": [0.8, 0.6]}, {"id": 3, "body": None, "kind": "b", "spot": [0.0, 1.0]}, {"id": 4, "body": "a blue fox", "kind": "b", "spot": None}])
    hits = c.search([[1.0, 0.0]], 2, output_fields=["kind"]).orderBy("rank").collect()
    assert [(r.id, round(r.distance, 6), r.kind) for r in hits] == [(1, 1.0, "a"), (2, 0.8, "a")]
    assert [r.id for r in c.search([[1.0, 0.0]], 5, "L2", expr="kind == 'b'").collect()] == [3]
    assert [r.id for r in c.search([[1.0, 0.0]], 5, radius=0.5, range_filter=0.9).collect()] == [2]
    groups = c.search([[1.0, 0.0]], 2, group_by="kind").orderBy("group_rank").collect()
    assert [(r.kind, r.id) for r in groups] == [("a", 1), ("b", 3)]
    boosted = c.search([[1.0, 0.0]], 3, ranker={"functions": [{"params": {"filter": "kind == 'b'", "weight": 3.0}}], "params": {"boost_mode": "sum"}}).orderBy("rank").collect()
    assert boosted[0].id == 3 and round(boosted[0].distance, 6) == 3.0
    found = c.search(["fox red"], 5, field="terms").orderBy("rank").collect()
    assert {r.id for r in found} == {1, 2, 4} and found[0].id == 1 and found[0].distance < 0
    assert c.search(["a blue fox"], 1, field="emb").first().id == 4
    pages = [[r.id for r in p.orderBy(F.desc("score")).collect()] for p in c.search_iterator([1.0, 0.0], batch=2, field="spot")]
    assert pages == [[1, 2], [3]]
    both = [{"queries": [[1.0, 0.0]], "limit": 3, "field": "spot"}, {"queries": ["fox"], "limit": 3, "field": "terms"}]
    fused = c.hybrid_search(both, "rrf", 2, output_fields=["kind"]).orderBy("rank").collect()
    assert fused[0].id == 1 and round(fused[0].score, 6) == round(2 / 61, 6) and fused[0].kind == "a"
    assert c.hybrid_search(both, "weighted", 4, weights=[0.5, 0.5], digits=3).count() == 4
    assert c.hybrid_search(both, "rrf", 2, group_by="kind").count() == 2
    chained = c.search([[1.0, 0.0]], 3, field="spot", chain=[{"op": "map", "expr": "round_decimal", "params": {"decimal": 1}, "inputs": ["$score"], "output": "$score"}, {"op": "sort", "by": "$score", "order": "asc"}, {"op": "limit", "limit": 2}], output_fields=[])
    assert [(r.id, r.distance, r["rank"]) for r in chained.orderBy("rank").collect()] == [(3, 0.0, 1), (2, 0.8, 2)]
    from orrery.functions import text as words

    packed = c.live().where("id = 2").select(words.sparse_to_bytes(F.col("terms")).alias("p"), "terms")
    again = packed.select("p", "terms", words.sparse_from_bytes(F.col("p")).alias("back")).first()
    assert again.back == again.terms and len(again.p) == 8 * len(again.terms)
    c.create_index("spot", "IVF_FLAT", "COSINE", {"nlist": 2})
    with pytest.raises(StateError):
        c.query()
    c.load()
    assert c.search([[1.0, 0.0]], 1).first().id == 1
    for _ in range(2):  # the second time from the written index
        assert [r.id for r in c.search_index([[1.0, 0.0]], 3, "spot", nprobe=2).orderBy("rank").collect()] == [1, 2, 3]
    with pytest.raises(StateError):
        c.drop_index("spot")
    c.release()
    c.drop_index("spot")
    assert not c.has_index() and c.describe()["num_entities"] == 4
    with pytest.raises(QueryError):
        c.search([[1.0]], 1)
    with pytest.raises(QueryError):
        c.search([[1.0, 0.0]], 1, "cosine")


class Crash(Exception):
    pass


def test_failed_appends_never_come_back(catalog, monkeypatch):
    c = catalog.create_collection("crashed", SPEC)
    c.insert([row(1)])
    with monkeypatch.context() as m:
        m.setattr(Collection, "_commit", lambda *a, **k: (_ for _ in ()).throw(Crash()))
        for wrong in (lambda: c.insert([row(100), row(101)]), lambda: c.delete([1]), lambda: c.upsert([{"id": 1, "title": "no"}])):
            with pytest.raises(Crash):
                wrong()
    assert ids(c.query()) == [1]
    c.insert([row(2), row(3)])
    again = catalog.collection("crashed")
    assert ids(again.query()) == [1, 2, 3] and again.query("id == 1").first().title is None
    assert again.recover() == 3 and again.recover() == 0 and ids(again.query()) == [1, 2, 3]
    c.compact()
    assert ids(again.query()) == [1, 2, 3] and again.files.list("data") == [f"_append={again.state['data'][0]['tag']}"]


def test_two_writers(catalog):
    a = catalog.create_collection("two", SPEC)
    b = catalog.collection("two")
    state = a.state
    entries, change, _ = a._append([row(1)], "_default", state)
    b.insert([row(2)])
    with pytest.raises(StateError):
        a._commit(state["next_seq"], entries, **change)
    assert ids(a.query()) == [2]
    a.create_snapshot("s")
    b.alter_properties({"x": 1})
    assert a.state["properties"] == {"x": 1} and b.list_snapshots() == ["s"]


def test_snapshots_pin_dropped_partitions(catalog):
    c = catalog.create_collection("pins", SPEC)
    c.create_partition("p")
    c.insert([row(1), row(2)])
    c.insert([row(7)], "p")
    c.create_snapshot("s")
    c.drop_partition("p")
    assert ids(c.query()) == [1, 2] and ids(c.snapshot_rows("s")) == [1, 2, 7]
    c.create_partition("p")
    c.insert([row(8)], "p")
    c.delete([1])
    assert ids(c.query()) == [2, 8] and ids(c.query(partitions=["p"])) == [8]
    c.compact()
    assert ids(c.query()) == [2, 8] and ids(catalog.restore_snapshot("pins", "s", "old").query()) == [1, 2, 7]
    c.drop_snapshot("s")
    assert len(c.files.list("data")) == 1 and ids(c.query()) == [2, 8]


def test_compacted_base_and_tail(catalog, monkeypatch):
    from orrery.sources import store

    c = catalog.create_collection("base", SPEC)
    c.create_partition("p")
    want = {}
    rng = random.Random(2)
    monkeypatch.setattr(store, "MERGE_APPENDS", 5)
    for turn in range(14):
        keys = rng.sample(range(12), 3)
        if rng.random() < 0.35:
            c.delete(keys)
            want = {k: v for k, v in want.items() if k not in keys}
        else:
            c.insert([row(k, title=f"t{turn}") for k in keys], rng.choice(["_default", "p"]))
            want |= {k: f"t{turn}" for k in keys}
        if turn in (4, 9):
            c.compact()
        if turn == 11:
            c.collect_tombstones()
        assert {r.id: r.title for r in c.query().collect()} == want
    assert len(c.state["data"]) + len(c.state["deletes"]) <= 6
    c.compact()
    plan = c.query("title == 't3'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(title,t3)" in plan and "Aggregate" not in plan


def test_batches_count_once(catalog, spark, monkeypatch):
    c = catalog.create_collection("batches", CollectionSpec((FieldSpec("id", "INT64", primary=True, auto_id=True), FieldSpec("spot", "FLOAT_VECTOR", dim=2))))
    rows = spark.createDataFrame([([1.0, 2.0],)], "spot array<float>")
    assert c.apply(rows, None, 0) and not c.apply(rows, None, 0)
    with monkeypatch.context() as m:
        m.setattr(Collection, "_change", lambda *a: (_ for _ in ()).throw(Crash()))
        with pytest.raises(Crash):
            c.apply(rows, None, 1)
    assert c.apply(rows, None, 1) and ids(c.query()) == [1, 2]


def test_more_sparse_hits_than_any_limit(catalog, spark):
    spec = CollectionSpec((FieldSpec("id", "INT64", primary=True), FieldSpec("body", "VARCHAR", analyzer={}), FieldSpec("kind", "INT32"), FieldSpec("terms", "SPARSE_FLOAT_VECTOR", nullable=True)), (FunctionSpec("f", "BM25", "body", "terms"),))
    c = catalog.create_collection("many", spec)
    c.insert(spark.range(20_000).select("id", F.lit("same words").alias("body"), (F.col("id") >= 17_000).cast("int").alias("kind")))
    assert {r.kind for r in c.search(["words"], 5, field="terms", group_by="kind", output_fields=["kind"]).collect()} == {0, 1}
    assert c.search(["words"], 5, field="terms", ranker={"functions": [{"params": {"filter": "kind == 1", "weight": 9.0}}]}).agg(F.min("id")).first()[0] == 17_000


def test_grouped_fusion_of_distances(catalog):
    c = catalog.create_collection("far", SPEC)
    c.insert([row(1, tenant="a"), row(2, tenant="a"), row(9, tenant="b")])
    both = [{"queries": [[1.0, 1.0]], "limit": 3, "metric": "L2"}] * 2
    assert [r.id for r in c.hybrid_search(both, "max", 1, group_by="tenant").collect()] == [1]
    assert [r.id for r in c.hybrid_search(both, "max", 2).orderBy("rank").collect()] == [1, 2]


def test_catalog(catalog):
    catalog.create_database("other", {"timezone": "Europe/Rome"})
    c = catalog.create_collection("c", SPEC, database="other")
    assert c.timezone == "Europe/Rome" and catalog.list_databases() == ["default", "other"]
    catalog.create_alias("c", "nick", "other")
    assert catalog.collection("nick", "other").name == "c" and catalog.list_aliases("c", "other") == ["nick"]
    catalog.rename_collection("c", "d", "other")
    assert catalog.resolve("nick", "other") == "d" and catalog.describe_alias("nick", "other")["collection"] == "d"
    for wrong in (lambda: catalog.create_database("other"), lambda: catalog.create_alias("d", "nick", "other"), lambda: catalog.create_collection("nick", SPEC, database="other")):
        with pytest.raises(AlreadyExistsError):
            wrong()
    for wrong in (lambda: catalog.collection("c", "other"), lambda: catalog.describe_database("no"), lambda: catalog.alter_alias("d", "x", "other")):
        with pytest.raises(NotFoundError):
            wrong()
    with pytest.raises(StateError):
        catalog.drop_database("other")
    catalog.drop_collection("d", "other")
    assert catalog.list_aliases(database="other") == []
    catalog.drop_database("other")
    with pytest.raises(SchemaError):
        catalog.create_database("1x")
    catalog.close()
    with pytest.raises(StateError):
        catalog.list_collections()


@pytest.mark.parametrize(
    "fields",
    [
        (FieldSpec("id", "INT64"), FieldSpec("v", "FLOAT_VECTOR", dim=2)),
        (FieldSpec("id", "INT64", primary=True),),
        (FieldSpec("id", "DOUBLE", primary=True), FieldSpec("v", "FLOAT_VECTOR", dim=2)),
        (FieldSpec("id", "INT64", primary=True), FieldSpec("v", "FLOAT_VECTOR")),
        (FieldSpec("id", "INT64", primary=True), FieldSpec("ISO", "INT64"), FieldSpec("v", "FLOAT_VECTOR", dim=2)),
        (FieldSpec("id", "VARCHAR", primary=True, auto_id=True), FieldSpec("v", "FLOAT_VECTOR", dim=2)),
        (FieldSpec("id", "INT64", primary=True), FieldSpec("a", "ARRAY"), FieldSpec("v", "FLOAT_VECTOR", dim=2)),
    ],
)
def test_schema_rules(fields):
    with pytest.raises(SchemaError):
        CollectionSpec(fields)


def test_streams(spark, catalog, tmp_path):
    rows = [(1, 10, "upsert", "a"), (2, 11, "upsert", "b"), (1, 12, "delete", None), (3, 13, "upsert", "c")]
    df = spark.createDataFrame(rows, "id long, s long, _op string, title string")
    src = str(tmp_path / "in")
    df.repartition(1).write.parquet(src)
    c = catalog.create_collection("streamed", SPEC)
    stream = spark.readStream.schema(df.schema).parquet(src).drop("s").withColumn("spot", F.array(F.lit(1.0), F.lit(2.0)))
    for _ in range(2):
        apply_mutations(stream, c, str(tmp_path / "ckpt")).awaitTermination()
    assert ids(c.query()) == [2, 3]
    q = latest_state(spark.readStream.schema(df.schema).parquet(src), "id", "s", "_op", "title").writeStream.format("memory").queryName("latest").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.id, r.s, r._op) for r in spark.sql("SELECT * FROM latest").collect()) == [(1, 12, "delete"), (2, 11, "upsert"), (3, 13, "upsert")]
