"""Queries that run through collections: rows are written, changed and read by the store, not by its parts.

Each query has a catalog of its own in the shared folder; nothing of it is read by another one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.queries import _TWO, _bm25_sql, _top, probes, query, read, shown, vectors
from orrery.schema import CollectionSpec, FieldSpec, FunctionSpec
from orrery.sources.catalog import Catalog
from orrery.sources.files import shared_folder
from orrery.sources.store import Collection
from orrery.streaming import apply_mutations

ORDERS = CollectionSpec(
    (
        FieldSpec("id", "INT64", primary=True),
        FieldSpec("price", "DOUBLE", nullable=True),
        FieldSpec("priority", "VARCHAR", nullable=True),
        FieldSpec("note", "VARCHAR", default="none"),
        FieldSpec("v", "FLOAT_VECTOR", dim=2),
    )
)
VECTORS = CollectionSpec((FieldSpec("id", "INT64", primary=True), FieldSpec("label", "INT32"), FieldSpec("vector", "FLOAT_VECTOR", dim=64), FieldSpec("back", "FLOAT_VECTOR", dim=64)))
TEXTS = CollectionSpec(
    (FieldSpec("id", "INT64", primary=True), FieldSpec("text", "VARCHAR", analyzer={}, nullable=True), FieldSpec("lang", "VARCHAR", nullable=True), FieldSpec("n_chars", "INT64", nullable=True), FieldSpec("terms", "SPARSE_FLOAT_VECTOR", nullable=True)),
    (FunctionSpec("terms_of_text", "BM25", "text", "terms"),),
)


def catalog(spark: SparkSession) -> Catalog:
    return Catalog(spark, f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}")


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    price = F.col("o_totalprice")
    return o.select(F.col("o_orderkey").alias("id"), price.alias("price"), F.col("o_orderpriority").alias("priority"), F.array(price, -price).cast("array<float>").alias("v"))


def changed_orders(spark: SparkSession, sf: str) -> Collection:
    """All orders; then prices of every third key cut by half, the note of every seventh changed, and some deleted by key and by filter."""
    c = catalog(spark).create_collection("orders", ORDERS)
    rows = _orders(spark, sf)
    c.insert(rows)
    c.upsert(rows.where("id % 3 = 0").select("id", (F.col("price") / 2).alias("price")))
    c.upsert(rows.where("id % 7 = 0").select("id", F.concat(F.lit("order "), "id").alias("note")))
    c.delete_where("price > 250000 or (priority == '5-LOW' and price < 20000)")
    c.delete([1, 2, 3, 7, 21, 10**12])
    c.insert(rows.where("id = 7"))
    return c


_CHANGED = """WITH a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 2 ELSE o_totalprice END AS price, o_orderpriority AS priority, CASE WHEN o_orderkey % 7 = 0 THEN 'order ' || o_orderkey ELSE 'none' END AS note FROM orders),
c AS (SELECT * FROM a WHERE NOT (price > 250000 OR (priority = '5-LOW' AND price < 20000)) AND id NOT IN (1, 2, 3, 7, 21) UNION ALL SELECT o_orderkey, o_totalprice, o_orderpriority, 'none' FROM orders WHERE o_orderkey = 7)"""


@query(f"{_CHANGED} SELECT id, round(price, 4) AS price, priority, note FROM c")
def collection_mutations(spark: SparkSession, sf: str) -> DataFrame:
    return changed_orders(spark, sf).query(output_fields=["id", "price", "priority", "note"]).withColumn("price", F.round("price", 4))


@query(f"{_CHANGED} SELECT id, note FROM c WHERE price BETWEEN 50000 AND 150000 AND priority IN ('1-URGENT', '2-HIGH')")
def collection_filtered_query(spark: SparkSession, sf: str) -> DataFrame:
    return changed_orders(spark, sf).query("price >= 50000 and price <= 150000 and priority in ['1-URGENT', '2-HIGH']", ["id", "note"])


@query(f"{_CHANGED} SELECT id, round(price, 4) AS price, note FROM c WHERE priority <> '5-LOW'")
def collection_compaction(spark: SparkSession, sf: str) -> DataFrame:
    """Written, compacted with an inverted index, and read by a filter that the scan takes."""
    c = changed_orders(spark, sf)
    c.create_index("priority", "INVERTED")
    c.compact()
    c.insert(c.live().where("id = 7").drop("_seq", "_partition"))  # one key that compaction has seen comes again
    c.load()
    return c.query("priority != '5-LOW'", ["id", "price", "note"]).withColumn("price", F.round("price", 4))


@query("SELECT o_orderkey AS id, round(o_totalprice, 4) AS price FROM orders")
def collection_snapshot_restore(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot still has all rows after changes, a dropped partition and a compaction."""
    cat = catalog(spark)
    c = cat.create_collection("orders", ORDERS)
    c.create_partition("late")
    rows = _orders(spark, sf)
    c.insert(rows.where("id % 2 = 0"))
    c.insert(rows.where("id % 2 = 1"), "late")
    c.create_snapshot("all")
    c.delete_where("price > 1000")
    c.upsert(rows.where("id % 5 = 0").withColumn("price", F.lit(0.0)))
    c.drop_partition("late")
    c.compact()
    return cat.restore_snapshot("orders", "all", "again").query(output_fields=["id", "price"]).withColumn("price", F.round("price", 4))


@query("SELECT (l_orderkey * 10 + l_linenumber) AS pos, o_orderkey AS id, round(o_totalprice, 4) AS price FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def collection_get(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of a frame of keys with repeats."""
    c = catalog(spark).create_collection("orders", ORDERS)
    c.insert(_orders(spark, sf))
    keys = read(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_orderkey").alias("key"))
    return c.get(keys, ["id", "price"]).withColumn("price", F.round("price", 4))


@query("SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 1000 ORDER BY id LIMIT 300")
def collection_query_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Three pages of the iterator; the page size is the feature."""
    c = catalog(spark).create_collection("orders", ORDERS)
    c.insert(_orders(spark, sf))
    pages = c.query_iterator("price > 1000", 100, ["id"])
    return next(pages).unionByName(next(pages)).unionByName(next(pages)).select("id")


def _vectors(spark: SparkSession, sf: str) -> Collection:
    c = catalog(spark).create_collection("vectors", VECTORS)
    c.insert(vectors(spark, sf).withColumn("back", F.reverse("vector")))
    return c


@query(_top("COSINE", where="e.label <> 7"))
def collection_search(spark: SparkSession, sf: str) -> DataFrame:
    c = _vectors(spark, sf)
    c.delete_where("label == 7")
    return shown(c.search(probes(spark, sf), 10, "COSINE", field="vector").withColumnRenamed("distance", "score"), "rank")


@query(_top("L2", 5, 3, where="e.label IN (2, 4)", keep="score >= 0.5 AND score < 1.9"))
def collection_search_range(spark: SparkSession, sf: str) -> DataFrame:
    hits = _vectors(spark, sf).search(probes(spark, sf), 5, "L2", field="vector", expr="label in [2, 4]", radius=1.9, range_filter=0.5, offset=3)
    return shown(hits.withColumnRenamed("distance", "score"), "rank")


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id AS id, list_inner_product(embedding::DOUBLE[], qv) AS score FROM embeddings, q) SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 120""")
def collection_search_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Three pages of hits of the first vector; the page size is the feature."""
    c = _vectors(spark, sf)
    vector = list(vectors(spark, sf).where("id = 0").first().vector)
    pages = c.search_iterator(vector, "IP", 40, "vector")
    return next(pages).unionByName(next(pages)).unionByName(next(pages)).select("id", F.round("score", 6).alias("score"))


@query(_TWO.format(agg="sum(1.0 / (60 + rank))"))
def collection_hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    q = probes(spark, sf)
    routes = [{"queries": q, "limit": 20, "field": "vector", "metric": "COSINE"}, {"queries": q, "limit": 20, "field": "back", "metric": "L2"}]
    return shown(_vectors(spark, sf).hybrid_search(routes, "rrf", 10), "rank")


@query(_bm25_sql("d.lang <> 'de'").replace("round(score, 3) AS score", "-round(score, 3) AS score"))
def collection_bm25(spark: SparkSession, sf: str) -> DataFrame:
    """The best documents outside one language, by statistics of all."""
    c = catalog(spark).create_collection("texts", TEXTS)
    c.insert(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "n_chars"))
    q = read(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return shown(c.search(q, 10, field="terms", expr="lang != 'de'"), "rank", score=F.round("distance", 3))


@query("SELECT event_id AS id, event_type AS note FROM events WHERE event_type <> 'error'")
def collection_stream(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of upserts and deletes, started again after its end: every batch counts once."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    e = read(spark, sf, "events")
    change = F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("_op")
    e.select(F.col("event_id").alias("id"), F.col("event_type").alias("note"), F.array("value", "value").cast("array<float>").alias("v"), change).write.parquet(f"{folder}/in")
    c = catalog(spark).create_collection("events", ORDERS)
    schema = spark.read.parquet(f"{folder}/in").schema
    for _ in range(2):
        apply_mutations(spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in"), c, f"{folder}/checkpoint").awaitTermination()
    return c.query(output_fields=["id", "note"])

