"""The thin ``opN_<name>`` queries over the test tables, and SQL for those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import decontam, html_extract, langid, license_scan, ngram_join, packing, pii, sharding, suffix_dedup, vector_join

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_sets(_read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op1_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(_read(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_dom_tree_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.extract(_read(spark, sf_dir, "documents"))
    counts = [F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in pii.KINDS]
    spans = F.array_join(F.transform(F.concat("base", "secrets"), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *counts, "base_sha256", spans.alias("spans"), (F.size("base") + F.size("secrets")).cast("long").alias("n_spans"))


def op6_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), decontam.contaminated().alias("contaminated"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.detect(_read(spark, sf_dir, "documents"))
    places, labels = F.col("base")["at"], F.col("base")["label"]
    own = F.col("spans")["label"]
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    score = F.greatest(F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.lit(0.0)), F.coalesce(F.array_max(F.col("spans")["cover"]), F.lit(0.0)))
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"), join(labels).alias("base_labels"), join(F.concat(labels, own)).alias("labels"), score.alias("score"))


def op9_subspace_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.near_vectors(_read(spark, sf_dir, "embeddings"))


def op10_radix_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(_read(spark, sf_dir, "documents"), passage=suffix_dedup.PASSAGE)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_sampled_splitters, op2_ngram_jaccard_join, op3_language_id, op4_dom_tree_model, op5_personal_data, op6_sum_of_squares_packing, op7_benchmark_decontamination, op8_license_scan, op9_subspace_pigeonhole, op10_radix_suffix_dedup)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = """reach AS (SELECT {id} AS a, {id} AS c FROM {table} UNION SELECT l.b, r.c FROM reach r JOIN both_ways l ON l.a = r.a),
component AS (SELECT a, min(c) AS c FROM reach GROUP BY a)"""

OP2_SQL = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 80 * (na.n + nb.n - o)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
{_REACH.format(id="doc_id", table="documents")}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT count(*) FROM both_ways b WHERE b.a = d.doc_id) AS n_similar, c.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN component c ON c.a = d.doc_id"""

OP7_SQL = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM pos JOIN win USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP9_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
both_ways AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
{_REACH.format(id="vec_id", table="embeddings")}
SELECT m.vec_id, (SELECT count(*) FROM both_ways b WHERE b.a = m.vec_id) AS n_links, c.c AS component_id, m.vec_id = c.c AS kept FROM embeddings m JOIN component c ON c.a = m.vec_id"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": OP2_SQL, "op7_benchmark_decontamination": OP7_SQL, "op9_subspace_pigeonhole": OP9_SQL}
