"""The engine's operators as queries over the test tables, each with the SQL that gives the same rows.

Searches take every row whose id is divisible by 50 as a query, against all rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import metrics, temporal, text
from orrery.operators import ann, fulltext, fusion, live
from orrery.operators.knn import grouped_top_k, knn, knn_matrix, order, scored, top_k
from orrery.operators.scan import Range, Weight, best_pairs
from orrery.plans.chain import Chain, expression, from_spec, hybrid
from orrery.plans.filter import predicate
from orrery.schema import CollectionSpec, FieldSpec
from orrery.sources.files import shared_folder
from orrery.sources.store import key_bucket, numbered

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        n = name or f.__name__
        QUERIES[n] = f
        if sql:
            SQL[n] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- vectors


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label"), F.col("embedding").alias("vector"))


def probes(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvector"))


def shown(hits: DataFrame, *more: str, score: Column | None = None) -> DataFrame:
    return hits.select("qid", "id", F.round(score if score is not None else F.col("score"), 6).alias("score"), *[F.col(c).cast("long").alias(c) for c in more])


_Q = "q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 50 = 0)"
_SCORE = {"COSINE": "list_cosine_similarity(e.embedding::DOUBLE[], q.qv)", "IP": "list_inner_product(e.embedding::DOUBLE[], q.qv)", "L2": "power(list_distance(e.embedding::DOUBLE[], q.qv), 2)"}


def _scores(metric: str, where: str = "TRUE", name: str = "s") -> str:
    return f"{name} AS (SELECT q.qid, e.vec_id AS id, e.label, {_SCORE[metric]} AS score FROM embeddings e, q WHERE {where})"


def _top(metric: str, k: int = 10, offset: int = 0, where: str = "TRUE", keep: str = "TRUE") -> str:
    way = "ASC" if metric == "L2" else "DESC"
    return f"WITH {_Q}, {_scores(metric, where)}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score {way}, id) AS rank FROM s WHERE {keep}) SELECT qid, id, round(score, 6) AS score, rank - {offset} AS rank FROM r WHERE rank > {offset} AND rank <= {k + offset}"


def _knn(metric: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return shown(knn(vectors(spark, sf).drop("label"), probes(spark, sf), metric, 10), "rank")

    return run


for _m in ("COSINE", "IP", "L2"):
    query(_top(_m), f"knn_{_m.lower()}")(_knn(_m))


@query(_top("COSINE"))
def knn_matrix_batches(spark: SparkSession, sf: str) -> DataFrame:
    return shown(knn_matrix(vectors(spark, sf), probes(spark, sf), "COSINE", 10), "rank")


EMBEDDING_SPEC = CollectionSpec((FieldSpec("id", "INT64", primary=True), FieldSpec("label", "INT32"), FieldSpec("vector", "FLOAT_VECTOR", dim=64)))


@query(_top("COSINE", where="e.label IN (1, 3, 5) AND e.vec_id > 20"))
def knn_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return shown(knn(vectors(spark, sf), probes(spark, sf), "COSINE", 10, where=predicate("label in [1, 3, 5] and id > 20", EMBEDDING_SPEC)), "rank")


@query(_top("COSINE", 20, keep="score > 0.1 AND score <= 0.35"))
def knn_range_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return shown(knn(vectors(spark, sf), probes(spark, sf), "COSINE", 20, radius=0.1, range_filter=0.35), "rank")


@query(_top("L2", 20, keep="score >= 1.2 AND score < 1.6"))
def knn_range_l2(spark: SparkSession, sf: str) -> DataFrame:
    return shown(knn(vectors(spark, sf), probes(spark, sf), "L2", 20, radius=1.6, range_filter=1.2), "rank")


@query(_top("IP", 7, 5))
def knn_offset(spark: SparkSession, sf: str) -> DataFrame:
    return shown(knn(vectors(spark, sf), probes(spark, sf), "IP", 7, offset=5), "rank")


_GROUPED = f"""WITH {_Q}, {_scores("COSINE")},
w AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, id) AS rank FROM s),
k AS (SELECT *, count(*) OVER (PARTITION BY qid, label) AS n FROM w WHERE rank <= {{size}}),
h AS (SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS group_rank FROM k WHERE rank = 1 AND {{strict}})
SELECT k.qid, k.id, round(k.score, 6) AS score, k.rank, h.group_rank - {{offset}} AS group_rank FROM k JOIN h USING (qid, label) WHERE {{strict}} AND h.group_rank > {{offset}} AND h.group_rank <= {{groups}} + {{offset}}"""


@query(_GROUPED.format(size=2, strict="TRUE", offset=0, groups=4))
def knn_group_by(spark: SparkSession, sf: str) -> DataFrame:
    return shown(knn(vectors(spark, sf), probes(spark, sf), "COSINE", 4, group_by="label", group_size=2), "rank", "group_rank")


@query(_GROUPED.format(size=45, strict="n = 45", offset=1, groups=3))
def knn_group_strict(spark: SparkSession, sf: str) -> DataFrame:
    return shown(knn(vectors(spark, sf), probes(spark, sf), "COSINE", 3, group_by="label", group_size=45, strict=True, offset=1), "rank", "group_rank")


def _boosted_sql(metric: str, new: str) -> str:
    way = "ASC" if metric == "L2" else "DESC"
    return f"WITH {_Q}, {_scores(metric)}, b AS (SELECT qid, id, {new} AS score FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score {way}, id) AS rank FROM b) SELECT qid, id, round(score, 6) AS score, rank FROM r WHERE rank <= 10"


def _boosted(spark: SparkSession, sf: str, metric: str, functions: list, function_mode: str, boost_mode: str) -> DataFrame:
    any_, value = fusion.boost_value(functions, function_mode)
    hits = best_pairs(vectors(spark, sf), probes(spark, sf), metric, 10, carry=["label"], weight=Weight(boost_mode, value, any_))
    return shown(top_k(hits.withColumn("score", fusion.boost(F.col("score"), metric, functions, function_mode, boost_mode)), order(metric), 10), "rank")


@query(_boosted_sql("COSINE", "score * CASE WHEN label < 4 THEN 1.5 ELSE 1 END * CASE WHEN id % 2 = 0 THEN 0.5 ELSE 1 END"))
def knn_boost_multiply(spark: SparkSession, sf: str) -> DataFrame:
    return _boosted(spark, sf, "COSINE", [(F.col("label") < 4, 1.5), (F.col("id") % 2 == 0, 0.5)], "multiply", "multiply")


@query(_boosted_sql("L2", "power(sqrt(score) + CASE WHEN label = 2 THEN 0.25 ELSE 0 END + CASE WHEN label > 1 THEN 0.5 ELSE 0 END, 2)"))
def knn_boost_sum(spark: SparkSession, sf: str) -> DataFrame:
    return _boosted(spark, sf, "L2", [(F.col("label") == 2, 0.25), (F.col("label") > 1, 0.5)], "sum", "sum")


_DECAYS = {
    "gauss": "exp(power(greatest(abs(label - 3) - 1, 0), 2) * ln(0.4) / 4.0)",
    "exp": "exp(greatest(abs(label - 3) - 1, 0) * ln(0.4) / 2.0)",
    "linear": "greatest(1 - greatest(abs(label - 3) - 1, 0) * 0.6 / 2.0, 0)",
}


def _decayed(kind: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        factor = expression("decay", {"function": kind, "origin": 3, "scale": 2, "offset": 1, "decay": 0.4})(F.col("label"))
        hits = best_pairs(vectors(spark, sf), probes(spark, sf), "COSINE", 10, carry=["label"], weight=Weight("scale", factor, nan_last=True))
        return shown(top_k(hits.withColumn("score", F.col("score") * factor), fusion.sort_key("score"), 10), "rank")

    return run


for _k, _e in _DECAYS.items():
    query(_boosted_sql("COSINE", f"score * {_e}"), f"knn_decay_{_k}")(_decayed(_k))


_BEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 20)"


@query(f"WITH {_Q}, {_scores('COSINE')} SELECT qid, id, round(0.7 * score + 0.3 * label, 6) AS weighted, round(greatest(score, label), 6) AS most, round((score + label) / 2, 6) AS mean, round(CASE WHEN label = 0 THEN 0 ELSE score * label END, 6) AS product FROM {_BEST}")
def num_combine_modes(spark: SparkSession, sf: str) -> DataFrame:
    """Combinations on the 20 best hits of each query."""
    hits = knn(vectors(spark, sf), probes(spark, sf), "COSINE", 20)
    pair = [F.col("score"), F.col("label")]
    some = [F.col("score"), F.nullif(F.col("label"), F.lit(0))]
    return hits.select("qid", "id", F.round(fusion.num_combine(pair, "weighted", [0.7, 0.3]), 6).alias("weighted"), F.round(fusion.num_combine(pair, "max"), 6).alias("most"), F.round(fusion.num_combine(pair, "avg"), 6).alias("mean"), F.round(fusion.num_combine(some, "multiply"), 6).alias("product"))


@query(f"""WITH {_Q}, {_scores('COSINE')}, b AS {_BEST},
v AS (SELECT b.qid, b.id, b.score AS c, list_inner_product(e.embedding::DOUBLE[], q.qv) AS i, power(list_distance(e.embedding::DOUBLE[], q.qv), 2) AS l FROM b JOIN embeddings e ON e.vec_id = b.id JOIN q USING (qid))
SELECT qid, id, round((1 + c) / 2, 6) AS cosine, round(0.5 + atan(i) / pi(), 6) AS ip, round(1 - 2 * atan(l) / pi(), 6) AS l2, round(2 * atan(abs(i)) / pi(), 6) AS bm25 FROM v""")
def score_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised scores of the 20 best hits of each query by every metric."""
    hits = knn(vectors(spark, sf).drop("label"), probes(spark, sf), "COSINE", 20, also=("IP", "L2"))
    s = {"COSINE": F.col("score"), "IP": F.col("score_ip"), "L2": F.col("score_l2")}
    n = {m: F.round(metrics.normalised(m, s[m]), 6).alias(m.lower()) for m in s}
    return hits.select("qid", "id", n["COSINE"], n["IP"], n["L2"], F.round(metrics.normalised("BM25", F.abs(s["IP"])), 6).alias("bm25"))


def _routes(spark: SparkSession, sf: str) -> list[tuple[DataFrame, str]]:
    """Two routes: the vectors by cosine, and reversed vectors by Euclidean distance."""
    v, q = vectors(spark, sf), probes(spark, sf)
    back = v.withColumn("vector", F.reverse("vector"))
    return [(knn(v, q, "COSINE", 20).select("qid", "id", "score", "label"), "COSINE"), (knn(back, q, "L2", 20).select("qid", "id", "score", "label"), "L2")]


_TWO = f"""WITH {_Q}, {_scores("COSINE", name="s1")},
s2 AS (SELECT q.qid, e.vec_id AS id, e.label, power(list_distance(list_reverse(e.embedding::DOUBLE[]), q.qv), 2) AS score FROM embeddings e, q),
r1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s1) WHERE rank <= 20),
r2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rank FROM s2) WHERE rank <= 20),
u AS (SELECT qid, id, label, score AS s, rank, 'COSINE' AS m FROM r1 UNION ALL SELECT qid, id, label, score, rank, 'L2' FROM r2),
f AS (SELECT qid, id, {{agg}} AS score FROM u GROUP BY qid, id),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f)
SELECT qid, id, round(score, 6) AS score, rank FROM o WHERE rank <= 10"""
_REL = "CASE WHEN m = 'L2' THEN 1 - 2 * atan(s) / pi() ELSE {} END"
_MERGES = {
    "hybrid_rrf": ("rrf", {"k": 60}, "sum(1.0 / (60 + rank))"),
    "hybrid_weighted": ("weighted", {"weights": [0.6, 0.4]}, f"sum(CASE WHEN m = 'L2' THEN 0.4 ELSE 0.6 END * {_REL.format('(1 + s) / 2')})"),
    "merge_max": ("max", {}, f"max({_REL.format('s')})"),
    "merge_sum": ("sum", {}, f"sum({_REL.format('s')})"),
    "merge_avg": ("avg", {}, f"avg({_REL.format('s')})"),
}


def _hybrid(how: str, args: dict) -> Query:
    return lambda spark, sf: shown(hybrid(_routes(spark, sf), how, 10, **args), "rank")


for _n, (_how, _args, _agg) in _MERGES.items():
    query(_TWO.format(agg=_agg), _n)(_hybrid(_how, _args))


@query(_TWO.split("o AS (")[0].format(agg="sum(1.0 / (60 + rank)), any_value(label) AS label").replace("AS label AS score", "AS label").replace("sum(1.0 / (60 + rank)),", "sum(1.0 / (60 + rank)) AS score,") + """w AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, id) AS rank FROM f),
k AS (SELECT * FROM w WHERE rank <= 2),
g AS (SELECT qid, label, sum(score) AS gs, min(id) FILTER (WHERE rank = 1) AS head FROM k GROUP BY qid, label),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(gs, 12) DESC, head) AS group_rank FROM g)
SELECT k.qid, k.id, round(k.score, 6) AS score, k.rank, o.group_rank, round(o.gs, 6) AS group_score FROM k JOIN o USING (qid, label) WHERE group_rank <= 3""")
def hybrid_grouped(spark: SparkSession, sf: str) -> DataFrame:
    merged = fusion.merge(_routes(spark, sf), "rrf").withColumn("score", F.round("score", 14))
    hits = fusion.group_hits(merged, "label", 3, 2, "sum")
    return hits.select("qid", "id", F.round("score", 6).alias("score"), *[F.col(c).cast("long").alias(c) for c in ("rank", "group_rank")], F.round("group_score", 6).alias("group_score"))


@query(f"""WITH {_Q}, {_scores("L2", name="s1")},
s2 AS (SELECT q.qid, e.vec_id AS id, e.label, power(list_distance(list_reverse(e.embedding::DOUBLE[]), q.qv), 2) AS score FROM embeddings e, q),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rank FROM s1) WHERE rank <= 20 UNION ALL SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rank FROM s2) WHERE rank <= 20),
f AS (SELECT qid, id, any_value(label) AS label, max(score) AS score FROM u GROUP BY qid, id),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY score, id) AS rank FROM f) WHERE rank <= 2),
o AS (SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS group_rank FROM k WHERE rank = 1)
SELECT k.qid, k.id, round(k.score, 6) AS score, k.rank, o.group_rank FROM k JOIN o USING (qid, label) WHERE group_rank <= 3""")
def hybrid_grouped_l2(spark: SparkSession, sf: str) -> DataFrame:
    """Distances alone: the group with the smallest comes first."""
    v, q = vectors(spark, sf), probes(spark, sf)
    routes = [(knn(x, q, "L2", 20).select("qid", "id", "score", "label"), "L2") for x in (v, v.withColumn("vector", F.reverse("vector")))]
    return shown(hybrid(routes, "max", 3, group="label", group_size=2), "rank", "group_rank")


@query(f"""WITH {_Q}, {_scores("COSINE")},
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 30),
m AS (SELECT qid, id, round(0.5 * score + 0.5 * {_DECAYS['linear']}, 4) AS score FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM m)
SELECT qid, id, score, rank - 2 AS rank FROM o WHERE rank > 2 AND rank <= 7""")
def function_chain(spark: SparkSession, sf: str) -> DataFrame:
    hits = knn(vectors(spark, sf), probes(spark, sf), "COSINE", 30)
    chain = from_spec(
        [
            {"op": "map", "expr": "decay", "params": {"function": "linear", "origin": 3, "scale": 2, "offset": 1, "decay": 0.4}, "inputs": ["label"], "output": "near"},
            {"op": "map", "expr": "num_combine", "params": {"weights": [0.5, 0.5], "mode": "weighted"}, "inputs": ["$score", "near"], "output": "$score"},
            {"op": "map", "expr": "round_decimal", "params": {"decimal": 4}, "inputs": ["$score"], "output": "$score"},
            {"op": "sort", "by": "$score", "order": "desc"},
            {"op": "limit", "limit": 5, "offset": 2},
        ],
        hits.columns,
    )
    return chain.execute(hits).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_Q}, {_scores('L2')}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY label, id) AS rank FROM s) SELECT qid, id, label, rank FROM r WHERE rank <= 4")
def chain_builder(spark: SparkSession, sf: str) -> DataFrame:
    # the order is one of the rows: the first 4 of all are the first 4 of each query
    first = vectors(spark, sf).where("vector IS NOT NULL").withColumn("qid", F.size("vector"))
    first = top_k(first, fusion.sort_key("label", False), 4).drop("qid", "rank")
    hits = scored(first, probes(spark, sf), "L2")
    return Chain().sort("label", descending=False).limit(4).select("$id", "label", "rank").execute(hits).select("qid", "id", "label", F.col("rank").cast("long").alias("rank"))


@query("SELECT vec_id AS id, CAST(conv AS DOUBLE) AS score FROM (SELECT vec_id, round(('0x' || substr(sha256('7:' || vec_id), 1, 16))::UHUGEINT::DOUBLE / 18446744073709551616.0, 9) AS conv FROM embeddings)")
def random_scores(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select("id", F.round(fusion.random_score(F.col("id"), 7), 9).alias("score"))


def _ann(kind: str) -> Query:
    """Written, with as much effort as the build has measured to be needed, and searched."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        v, q, path = vectors(spark, sf), probes(spark, sf), f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        if kind == "lsh":
            bits = ann.fit_lsh(v, "COSINE", 64)
            ann.build_lsh(v, ann.TABLES, bits, dim=64).write.parquet(path)
            return shown(ann.search_lsh(spark.read.parquet(path), q, "COSINE", 10, 64, ann.TABLES, bits), "rank")
        index = ann.build_ivf(v, "COSINE", sq8=kind == "ivf_sq8")
        index.write(path)
        index.rows = spark.read.parquet(path)
        return shown(ann.search_ivf(index, q, 10), "rank")

    return run


for _k in ("ivf_flat", "ivf_sq8", "lsh"):
    query(None, f"ann_{_k}")(_ann(_k))


@query(f"""WITH {_Q}, {_scores('COSINE')}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s WHERE score < 0.05)
SELECT qid, id, round(score, 6) AS score FROM r WHERE rank <= 50""")
def search_iterator_page(spark: SparkSession, sf: str) -> DataFrame:
    """The next page of 50 after the pages down to a score of 0.05; the page size is the feature."""
    hits = best_pairs(vectors(spark, sf), probes(spark, sf), "COSINE", 50, within=Range(high=0.05))
    return shown(top_k(hits, order("COSINE"), 50))


# -- text

_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
_POSTS = f"t AS (SELECT doc_id AS id, {_TOKENS.format('text')} AS toks FROM documents), p AS (SELECT id, len(toks) AS dl, unnest(toks) AS term FROM t), tf AS (SELECT id, dl, term, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").withColumnRenamed("doc_id", "id")


def _bm25_sql(where: str = "TRUE") -> str:
    return f"""WITH {_POSTS}, st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM t),
q AS (SELECT item_id AS qid, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT q.qid, tf.id, sum(ln(1 + (n - df + 0.5) / (0.5 + df)) * qtf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN documents d ON d.doc_id = tf.id, st WHERE {where} GROUP BY q.qid, tf.id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM s)
SELECT qid, id, round(score, 3) AS score, rank FROM r WHERE rank <= 10"""


def _bm25(spark: SparkSession, sf: str, where: Column | None = None) -> DataFrame:
    q = read(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    # scores that differ in the last bits only are ties
    return shown(fulltext.bm25(documents(spark, sf), q, text.analyzer(), 10, where=where, digits=9), "rank", score=F.round("score", 3))


query(_bm25_sql(), "bm25_topk")(lambda spark, sf: _bm25(spark, sf))
query(_bm25_sql("d.lang = 'en' AND d.n_chars > 500"), "bm25_filtered")(lambda spark, sf: _bm25(spark, sf, predicate("lang == 'en' and n_chars > 500", DOCUMENT_SPEC)))

DOCUMENT_SPEC = CollectionSpec((FieldSpec("id", "INT64", primary=True), FieldSpec("text", "VARCHAR"), FieldSpec("lang", "VARCHAR"), FieldSpec("source", "VARCHAR"), FieldSpec("n_chars", "INT64"), FieldSpec("v", "FLOAT_VECTOR", dim=1)))


@query(f"SELECT doc_id AS id FROM documents WHERE list_has_any({_TOKENS.format('text')}, ['the', 'licensed', 'que'])")
def text_match_or(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).where(predicate("text_match(text, 'The licensed QUE')", DOCUMENT_SPEC)).select("id")


@query(f"SELECT doc_id AS id FROM documents WHERE NOT list_has_any({_TOKENS.format('text')}, ['the', 'und'])")
def text_match_not(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).where(predicate("not text_match(text, 'the und')", DOCUMENT_SPEC)).select("id")


@query(f"WITH {_POSTS} SELECT id, term, tf, dl FROM tf")
def token_tf(spark: SparkSession, sf: str) -> DataFrame:
    p = fulltext.postings(documents(spark, sf), text.tokens(F.col("text")))
    return p.select("id", "term", "tf", F.col("dl").cast("long").alias("dl"))


@query(f"WITH {_POSTS} SELECT term, df FROM df")
def doc_freq(spark: SparkSession, sf: str) -> DataFrame:
    return fulltext.document_frequency(fulltext.postings(documents(spark, sf), text.tokens(F.col("text"))))


@query(f"WITH t AS (SELECT DISTINCT unnest({_TOKENS.format('text')}) AS term FROM documents) SELECT term, list_reduce(list_prepend(2166136261::HUGEINT, list_transform(range(1, octet_length(encode(term)) + 1), lambda i: ('0x' || substr(hex(encode(term)), 2 * i - 1, 2))::HUGEINT)), lambda h, b: (xor(h::UBIGINT, b::UBIGINT)::HUGEINT * 16777619) % 4294967296)::BIGINT AS term_id FROM t")
def fnv_term_ids(spark: SparkSession, sf: str) -> DataFrame:
    terms = documents(spark, sf).select(F.explode(text.tokens(F.col("text"))).alias("term")).distinct()
    return terms.select("term", text.fnv1a(F.col("term")).alias("term_id"))


@query(f"SELECT conv_id, turn, len(list_filter({_TOKENS.format('text')}, lambda x: x NOT IN ('the', 'of', 'and'))) AS n FROM conversations")
def analyzer_stop_words(spark: SparkSession, sf: str) -> DataFrame:
    a = text.analyzer({"filter": [{"stop_words": ["the", "of", "and"], "type": "stop"}]})
    return read(spark, sf, "conversations").select("conv_id", "turn", F.size(a(F.col("text"))).cast("long").alias("n"))


@query(f"""WITH {_POSTS}, q AS (SELECT item_id AS qid, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT qid, id, sum(tf * qtf)::DOUBLE AS score FROM tf JOIN q USING (term) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) SELECT qid, id, score, rank FROM r WHERE rank <= 10""")
def sparse_inner_product(spark: SparkSession, sf: str) -> DataFrame:
    def sparse(df: DataFrame, key: str, out: str) -> DataFrame:
        ids = F.map_from_entries(F.transform(F.map_entries(text.term_counts(text.tokens(F.col("text")))), lambda e: F.struct(text.fnv1a(e["key"]), e["value"].cast("float"))))
        return df.select(F.col(key).alias(out), ids.alias("sparse" if out == "id" else "qvector"))

    hits = fulltext.sparse_ip(sparse(read(spark, sf, "documents"), "doc_id", "id"), sparse(read(spark, sf, "benchmark"), "item_id", "qid"), 10)
    return shown(hits, "rank")


# -- filters on tables


def _spec(*fields: str, dynamic: bool = False) -> CollectionSpec:
    made = [FieldSpec(*f.split(":")[:2], nullable=True, element=f.split(":")[2] if f.count(":") == 2 else None) for f in fields]
    return CollectionSpec((FieldSpec("_id", "INT64", primary=True), *made, FieldSpec("_v", "FLOAT_VECTOR", dim=1)), dynamic=dynamic)


LINEITEM = _spec("l_orderkey:INT64", "l_linenumber:INT32", "l_quantity:DOUBLE", "l_extendedprice:DOUBLE", "l_discount:DOUBLE", "l_tax:DOUBLE", "l_returnflag:VARCHAR", "l_linestatus:VARCHAR", "l_shipdate:TIMESTAMPTZ", "flag:VARCHAR", "cut:DOUBLE")


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """With a nullable text and a nullable number derived from others."""
    t = read(spark, sf, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))
    return t.withColumn("flag", F.nullif(F.col("l_returnflag"), F.lit("A"))).withColumn("cut", F.nullif(F.col("l_discount"), F.lit(0.05)))


_L = "(SELECT *, nullif(l_returnflag, 'A') AS flag, nullif(l_discount, 0.05) AS cut FROM lineitem)"
_KEYS = "l_orderkey, l_linenumber"
_FILTERS = {
    "filter_cmp": ("l_quantity > 30 and l_discount <= 0.04 and l_returnflag != 'N'", "l_quantity > 30 AND l_discount <= 0.04 AND l_returnflag <> 'N'"),
    "filter_in": ("flag in ['R', 'N'] and l_linenumber in [1, 2, 9]", "coalesce(flag IN ('R', 'N'), FALSE) AND l_linenumber IN (1, 2, 9)"),
    "filter_not_in_null": ("flag not in ['R']", "NOT coalesce(flag IN ('R'), FALSE)"),
    "filter_like": ("l_linestatus like 'O%' and not (flag like 'N%')", "l_linestatus LIKE 'O%' AND NOT (flag LIKE 'N%')"),
    "filter_arith": ("l_extendedprice * (1 - l_discount) - 5 > 40000 or -l_quantity + 2 >= 1.0", "l_extendedprice * (1 - l_discount) - 5 > 40000 OR -l_quantity + 2 >= 1.0"),
    "filter_div_zero": ("l_quantity / (l_linenumber - 1) > 20", "CASE WHEN l_linenumber = 1 THEN l_quantity > 0 ELSE l_quantity / (l_linenumber - 1) > 20 END"),
    "filter_bool_kleene": ("not (cut > 0.03 and flag == 'R') or (cut < 0.01 and not flag == 'N')", "NOT (cut > 0.03 AND flag = 'R') OR (cut < 0.01 AND NOT flag = 'N')"),
    "filter_is_null": ("flag is null and cut is not null", "flag IS NULL AND cut IS NOT NULL"),
    "filter_ts_interval": ("l_shipdate + INTERVAL 'P30D' > ISO '1997-01-01T00:00:00Z' and l_shipdate < ISO '1997-01-01T00:00:00Z'", "l_shipdate + INTERVAL 30 DAY > TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'"),
    "filter_cross_field": ("l_tax > cut and l_discount != l_tax", "l_tax > cut AND l_discount <> l_tax"),
}


def _filtered(source: str) -> Query:
    return lambda spark, sf: lineitem(spark, sf).where(predicate(source, LINEITEM)).select("l_orderkey", "l_linenumber", F.col("l_quantity"))


for _n, (_src, _sql) in _FILTERS.items():
    query(f"SELECT {_KEYS}, l_quantity FROM {_L} WHERE {_sql}", _n)(_filtered(_src))

EVENTS = _spec("event_id:INT64", "user_id:INT64", "event_type:VARCHAR", "value:DOUBLE", "props:JSON", "ts:TIMESTAMPTZ", "kinds:ARRAY:VARCHAR", "ids:ARRAY:INT64")
EVENTS_DYNAMIC = _spec("event_id:INT64", dynamic=True)


def events(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_id FROM events WHERE (props->>'$.k')::INT = 3 OR (props->>'$.k')::INT > 90")
def json_path_eq(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).where(predicate("props['k'] == 3 or props['k'] > 90", EVENTS)).select("event_id")


@query("SELECT event_id FROM events WHERE (props->>'$.k') IS NOT NULL AND event_type <> 'view'")
def json_exists(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).where(predicate("exists props['k'] and not exists props['none'] and event_type != 'view'", EVENTS)).select("event_id")


def _with_meta(spark: SparkSession, sf: str) -> DataFrame:
    """The type of an event as a dynamic key; its value a number for purchases and text for others; null for errors."""
    e = events(spark, sf)
    mixed = F.when(F.col("event_type") == "purchase", F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("size")))).when(F.col("event_type") != "error", F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("size"))))
    return e.select("event_id", mixed.alias("$meta"))


@query("SELECT event_id FROM events WHERE event_type IN ('view', 'purchase') AND event_type = 'purchase' AND user_id >= 40 OR event_type = 'click'")
def meta_dynamic(spark: SparkSession, sf: str) -> DataFrame:
    return _with_meta(spark, sf).where(predicate("(kind in ['view', 'purchase'] and size >= 40) or $meta['kind'] == 'click'", EVENTS_DYNAMIC)).select("event_id")


@query("SELECT event_id FROM events WHERE event_type NOT IN ('error') AND NOT (event_type = 'purchase' AND user_id = 7)")
def meta_cross_type(spark: SparkSession, sf: str) -> DataFrame:
    return _with_meta(spark, sf).where(predicate("size != 7", EVENTS_DYNAMIC)).select("event_id")


def _lists(spark: SparkSession, sf: str) -> DataFrame:
    """Per user the kinds of events and the numbers of days that had one."""
    e = events(spark, sf)
    per = e.groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("kinds"), F.sort_array(F.collect_set(F.dayofmonth("ts").cast("long"))).alias("ids"))
    return per.withColumn("kinds", F.when(F.col("user_id") % 7 != 0, F.col("kinds"))).withColumn("props", F.to_json(F.struct(F.col("kinds").alias("list"), F.col("ids"))))


_LISTS = "(SELECT user_id, CASE WHEN user_id % 7 <> 0 THEN list_sort(list(DISTINCT event_type)) END AS kinds, list(DISTINCT day(ts)) AS ids FROM events GROUP BY user_id)"
_ARRAYS = {
    "array_contains": ("array_contains(kinds, 'error')", "coalesce(list_contains(kinds, 'error'), FALSE)"),
    "array_contains_all": ("array_contains_all(ids, [1, 2, 3])", "list_has_all(ids, [1, 2, 3])"),
    "array_contains_any": ("not array_contains_any(kinds, ['error', 'signup'])", "NOT coalesce(list_has_any(kinds, ['error', 'signup']), FALSE)"),
    "array_length": ("array_length(kinds) == 0 or array_length(ids) > 25", "coalesce(len(kinds), 0) = 0 OR len(ids) > 25"),
    "json_contains": ("json_contains(props['list'], 'click') and json_contains_any(props['ids'], [30, 31])", "coalesce(list_contains(kinds, 'click'), FALSE) AND list_has_any(ids, [30, 31])"),
    "array_element": ("kinds[0] == 'click' and ids[0] < 3", "coalesce(kinds[1] = 'click', FALSE) AND list_sort(ids)[1] < 3"),
}


def _on_lists(source: str) -> Query:
    return lambda spark, sf: _lists(spark, sf).where(predicate(source, EVENTS)).select("user_id")


for _n, (_src, _sql) in _ARRAYS.items():
    query(f"SELECT user_id FROM {_LISTS} WHERE {_sql}", _n)(_on_lists(_src))


@query("SELECT event_id, [year(l), month(l), day(l), hour(l), minute(l), second(l), epoch_us(ts) % 1000000] AS parts FROM (SELECT event_id, ts, ts + INTERVAL 9 HOUR AS l FROM events)")
def time_fields_tz(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", temporal.time_fields(F.col("ts"), list(temporal.FIELDS), "Asia/Tokyo").alias("parts"))


@query("SELECT event_id, CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS at FROM events")
def timestamp_rendering(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", temporal.iso_text(F.col("ts")).alias("at"))


PARTS = _spec("p_partkey:INT64", "shape:GEOMETRY")


def _places(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part")
    return p.select("p_partkey", F.concat(F.lit("POINT("), F.col("p_size").cast("string"), F.lit(" "), (F.col("p_partkey") % 50).cast("string"), F.lit(")")).alias("shape"))


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 30 AND p_partkey % 50 BETWEEN 5 AND 25 AND (p_partkey % 50 - 5) <= (p_size - 10)")
def geo_point_in_polygon(spark: SparkSession, sf: str) -> DataFrame:
    return _places(spark, sf).where(predicate("st_within(shape, 'POLYGON((10 5, 30 5, 30 25, 10 5))')", PARTS)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE sqrt(power(p_size - 20, 2) + power(p_partkey % 50 - 20, 2)) <= 7 + 1e-9")
def geo_dwithin(spark: SparkSession, sf: str) -> DataFrame:
    return _places(spark, sf).where(predicate("st_dwithin(shape, 'POINT(20 20)', 7)", PARTS)).select("p_partkey")


# -- the log

_DATA = "data AS (SELECT user_id AS pk, event_id AS _seq, value, event_type FROM events WHERE event_type <> 'error')"
_GONE = "gone AS (SELECT user_id AS pk, max(event_id) AS dseq FROM events WHERE event_type = 'error' GROUP BY user_id)"
_LIVE = f"{_DATA}, {_GONE}, newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY _seq DESC) AS rn FROM data) WHERE rn = 1), live AS (SELECT n.* FROM newest n LEFT JOIN gone USING (pk) WHERE dseq IS NULL OR dseq <= _seq)"


def _log(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = events(spark, sf)
    data = e.where("event_type <> 'error'").select(F.col("user_id").alias("pk"), F.col("event_id").alias("_seq"), "value", "event_type", F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("_partition"))
    return data, e.where("event_type = 'error'").select(F.col("user_id").alias("pk"), F.col("event_id").alias("_seq"))


@query(f"WITH {_LIVE} SELECT pk, _seq, value FROM newest")
def latest_version_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return live.live_rows(_log(spark, sf)[0], None, "pk").select("pk", "_seq", "value")


@query(f"WITH {_LIVE} SELECT pk, _seq, value FROM live")
def tombstone_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    return live.live_rows(*_log(spark, sf), "pk").select("pk", "_seq", "value")


@query(f"WITH {_LIVE} SELECT pk, _seq FROM live WHERE pk % 4 IN (1, 2)")
def live_partitions(spark: SparkSession, sf: str) -> DataFrame:
    return live.live_rows(*_log(spark, sf), "pk", ["p1", "p2"]).select("pk", "_seq")


@query(f"WITH {_LIVE.replace('FROM events WHERE', 'FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events) AND')} SELECT pk, _seq, value FROM live")
def snapshot_as_of_seq(spark: SparkSession, sf: str) -> DataFrame:
    """The log as it was at half of its numbers."""
    half = events(spark, sf).agg(F.max("event_id")).first()[0] // 2
    return live.live_rows(*_log(spark, sf), "pk", upto=half).select("pk", "_seq", "value")


@query(f"WITH {_LIVE}, c AS (SELECT user_id AS pk, max(event_id) AS value FROM events WHERE event_type = 'click' GROUP BY user_id) SELECT c.pk, c.value::DOUBLE AS value, live.event_type FROM c LEFT JOIN live USING (pk)")
def upsert_partial(spark: SparkSession, sf: str) -> DataFrame:
    rows = live.live_rows(*_log(spark, sf), "pk")
    changes = events(spark, sf).where("event_type = 'click'").groupBy(F.col("user_id").alias("pk")).agg(F.max("event_id").cast("double").alias("value"))
    return live.overlay(rows, changes, "pk", ["pk", "value", "event_type"])


@query(f"WITH {_LIVE} SELECT pk, _seq FROM live WHERE NOT (value > 50)")
def delete_by_filter(spark: SparkSession, sf: str) -> DataFrame:
    data, gone = _log(spark, sf)
    spec = _spec("pk:INT64", "value:DOUBLE")
    hit = live.live_rows(data, gone, "pk").where(predicate("value > 50", spec)).select("pk", F.lit(1 << 60).alias("_seq"))
    return live.live_rows(data, gone.unionByName(hit), "pk").select("pk", "_seq")


@query(f"WITH {_LIVE} SELECT count(*) AS rows, min(_seq) AS low, max(_seq) AS high FROM live")
def compaction_live(spark: SparkSession, sf: str) -> DataFrame:
    return live.live_rows(*_log(spark, sf), "pk").agg(F.count(F.lit(1)).alias("rows"), F.min("_seq").alias("low"), F.max("_seq").alias("high"))


@query(f"WITH {_LIVE} SELECT user_id AS pk, event_id AS _seq FROM events WHERE event_type = 'error' AND event_id > (SELECT min(_seq) FROM live)")
def gc_watermark(spark: SparkSession, sf: str) -> DataFrame:
    data, gone = _log(spark, sf)
    return live.tombstone_watermark(live.live_rows(data, gone, "pk"), gone)


@query("SELECT o_orderkey, '_pk_' || (('0x' || right(md5(o_orderkey::VARCHAR), 1))::INT)::VARCHAR AS bucket FROM orders")
def partition_key_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select("o_orderkey", key_bucket(F.col("o_orderkey")).alias("bucket"))


@query(f"WITH {_LIVE} SELECT count(*) AS n FROM live")
def count_star(spark: SparkSession, sf: str) -> DataFrame:
    return live.live_rows(*_log(spark, sf), "pk").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LIVE} SELECT count(*) AS n FROM live WHERE value < 20 AND event_type = 'view'")
def count_filtered(spark: SparkSession, sf: str) -> DataFrame:
    rows = live.live_rows(*_log(spark, sf), "pk")
    return rows.where(predicate("value < 20 and event_type == 'view'", _spec("value:DOUBLE", "event_type:VARCHAR"))).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LIVE} SELECT 'p' || (pk % 4) AS _partition, count(*) AS n FROM live GROUP BY ALL")
def num_entities_by_partition(spark: SparkSession, sf: str) -> DataFrame:
    return live.live_rows(*_log(spark, sf), "pk").groupBy("_partition").agg(F.count(F.lit(1)).alias("n"))


@query("WITH w AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS pos, l_orderkey AS k FROM lineitem) SELECT w.pos, o.o_orderkey, o.o_totalprice FROM w JOIN orders o ON o.o_orderkey = w.k")
def get_by_pk(spark: SparkSession, sf: str) -> DataFrame:
    """Rows for a list of keys with repeats: the orders of all line items, in their order."""
    keys = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber")
    # written once in order, then numbered by the sizes of the parts before: no part is computed twice
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    keys.repartitionByRange("k", "l_linenumber").sortWithinPartitions("k", "l_linenumber").withColumn("_n", F.monotonically_increasing_id()).write.parquet(path)
    placed = numbered(spark.read.parquet(path), 0)[0].select(F.col("_seq").alias("pos"), "k")
    return placed.join(read(spark, sf, "orders"), F.col("k") == F.col("o_orderkey")).select("pos", "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100")
def query_iterator_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page of the iterator: the page size is the feature."""
    return read(spark, sf, "orders").where("o_orderkey > 500").orderBy("o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_mktsegment, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') OR c_acctbal < 0")
def collection_from_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a collection built from dimension tables, under a filter."""
    rows = read(spark, sf, "customer").join(F.broadcast(read(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(read(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    spec = _spec("r_name:VARCHAR", "c_acctbal:DOUBLE")
    return rows.where(predicate("r_name in ['ASIA', 'EUROPE'] or c_acctbal < 0", spec)).select("c_custkey", "c_mktsegment", "n_name", "r_name")


from orrery import store_queries  # noqa: E402  adds its queries to the ones here

__all__ = ["QUERIES", "SQL", "grouped_top_k", "store_queries"]
