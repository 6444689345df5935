"""BM25 and sparse inner-product ranking with statistics over all live rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.knn import top_k

K1 = 1.5
B = 0.75
#: Different terms that the queries scored in one pass have about; more queries are scored in groups.
BROADCAST_TERMS = 1_000_000
#: Scores of documents and queries that are held at once.
CELLS = 2_000_000


def postings(docs: DataFrame, tokens: Column, id_col: str = "id") -> DataFrame:
    """(id, term, tf, dl): term counts by a partial and a final aggregate; documents without terms have none."""
    words = docs.select(F.col(id_col).alias("id"), tokens.alias("_t"))
    each = words.select("id", F.size("_t").alias("dl"), F.explode("_t").alias("term"))
    return each.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(queries: DataFrame, tokens: Column) -> DataFrame:
    """(qid, term, qtf) of queries (qid, text)."""
    return queries.select("qid", F.explode(tokens).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` for work that takes far longer than moving them: in at least as many parts as there are cores, if they came in fewer."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def statistics(corpus: DataFrame, wanted: DataFrame) -> tuple[int, float, dict[str, int]]:
    """(documents, mean length, document frequency of the ``wanted`` terms) of ``corpus`` (tokens ``_t``), in one pass.

    A document sends its different wanted terms, and its length under a mark that is no term; both are counted before anything moves.
    """
    mark = F.lit("").alias("term")  # no token is empty
    each = corpus.select(F.size("_t").alias("dl"), F.explode(F.concat(F.array(mark), F.array_distinct("_t"))).alias("term"))
    rows = each.join(F.broadcast(wanted.union(wanted.sparkSession.range(1).select(mark))), "term")
    got = {r.term: (r.n, r.dl) for r in rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("dl")).collect()}  # one row for each term of the queries
    n, length = got.pop("", (0, 0))
    return n, (length / n if n else 0.0), {t: c for t, (c, _) in got.items()}


def bm25_scores(docs: DataFrame, queries: DataFrame, tokens, *, text: str = "text", id_col: str = "id", where: Column | None = None, k1: float = K1, b: float = B, best: int | None = None, digits: int | None = None) -> DataFrame:  # noqa: ANN001
    """(qid, id, score) of all documents that share a term with a query, score being the relevance.

    Statistics are those of all ``docs``, with or without a filter: N and the mean length count documents without terms, too. Terms of
    the query that repeat weigh as often. The corpus is read twice, for the statistics and for the scores, and never shuffled: a
    document's terms are counted and weighed in the Arrow batch it came in. ``digits`` rounds scores; with ``best`` each batch keeps
    that many hits of a query only (ties by the smaller id), which is enough for a top-k of that size.
    """
    spark = docs.sparkSession
    none = F.array().cast("array<string>")
    corpus = spread(docs.select(F.col(id_col).alias("id"), F.col(text).alias("_text"), *([where.alias("_ok")] if where is not None else [])))
    corpus = corpus.withColumn("_t", F.coalesce(tokens(F.col("_text")), none)).drop("_text")
    q = query_terms(queries.select("qid", F.col(text)), tokens(F.col(text)))
    n, avgdl, df = statistics(corpus.select("_t"), q.select("term").distinct())
    hits = corpus.where("_ok").drop("_ok") if where is not None else corpus
    kind, qkind = hits.schema["id"].dataType.simpleString(), q.schema["qid"].dataType.simpleString()
    parts, held, terms = [], {}, 0
    for r in q.where(F.col("term").isin(list(df)) if len(df) < 100 else F.lit(True)).orderBy("qid").toLocalIterator():
        if r.term in df:
            if r.qid not in held and terms > BROADCAST_TERMS:
                parts.append(held)
                held, terms = {}, 0
            held.setdefault(r.qid, []).append((r.term, float(np.log((n - df[r.term] + 0.5) / (df[r.term] + 0.5) + 1)) * r.qtf))
            terms += 1
    out = None
    for group in [*parts, held]:
        one = _weighed(hits, group, f"qid {qkind}, id {kind}, score double", k1, b, avgdl, best, digits) if group else spark.createDataFrame([], f"qid {qkind}, id {kind}, score double")
        out = one if out is None else out.unionByName(one)
    return out


def _weighed(corpus: DataFrame, queries: dict, schema: str, k1: float, b: float, avgdl: float, best: int | None, digits: int | None) -> DataFrame:
    """Scores of one group of queries, {qid: [(term, weight)]}."""
    names = sorted({t for ts in queries.values() for t, _ in ts})
    number = {t: i for i, t in enumerate(names)}
    of = sorted((number[t], k, w) for k, ts in enumerate(queries.values()) for t, w in ts)  # by term: its queries and weights
    start = np.searchsorted([x[0] for x in of], np.arange(len(names) + 1))
    shared = corpus.sparkSession.sparkContext.broadcast((names, list(queries), start, np.array([x[1] for x in of]), np.array([x[2] for x in of])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, qids, start, qs, ws = shared.value
        wanted, asked = pa.array(names, pa.string()), pa.array(qids)
        step = max(1, CELLS // len(qids))
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                ids, col = batch.column(0).slice(i, step), batch.column(1).slice(i, step)
                dl = pc.list_value_length(col).to_numpy(zero_copy_only=False)
                term = pc.fill_null(pc.index_in(col.flatten(), value_set=wanted), -1).to_numpy()
                doc = np.repeat(np.arange(len(dl)), dl)[term >= 0]
                cell, tf = np.unique(doc * len(names) + term[term >= 0], return_counts=True)
                d, t = cell // len(names), cell % len(names)
                part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[d] / avgdl)) if len(d) else np.zeros(0)
                m = start[t + 1] - start[t]
                at = np.repeat(start[t], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                where = np.repeat(d, m) * len(qids) + qs[at]
                score = np.bincount(where, np.repeat(part, m) * ws[at], len(dl) * len(qids))
                hit = np.flatnonzero(np.bincount(where, minlength=len(dl) * len(qids)))
                score = score[hit] if digits is None else np.round(score[hit], digits)
                d, k = hit // len(qids), hit % len(qids)
                if best is not None and len(hit):
                    order = np.lexsort((pc.rank(ids, tiebreaker="dense").to_numpy()[d], -score, k))
                    first = np.flatnonzero(np.r_[True, np.diff(k[order]) != 0])
                    place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
                    order = order[place < best]
                    d, k, score = d[order], k[order], score[order]
                yield pa.record_batch([asked.take(pa.array(k)), ids.take(pa.array(d)), pa.array(score)], names=["qid", "id", "score"])

    return corpus.select("id", "_t").mapInArrow(run, schema)


def bm25(docs: DataFrame, queries: DataFrame, tokens, k: int = 10, *, text: str = "text", id_col: str = "id", where: Column | None = None, k1: float = K1, b: float = B, offset: int = 0, digits: int | None = None) -> DataFrame:  # noqa: ANN001
    """(qid, id, score, distance, rank): relevance and its negative, best first; see ``bm25_scores``. The best of each batch are all that is shuffled."""
    hits = bm25_scores(docs, queries, tokens, text=text, id_col=id_col, where=where, k1=k1, b=b, best=k + offset, digits=digits)
    return top_k(hits, [F.col("score").desc(), F.col("id").asc()], k, offset).withColumn("distance", -F.col("score"))


def sparse_scores(rows: DataFrame, queries: DataFrame, *, vector: str = "sparse", id_col: str = "id") -> DataFrame:
    """(qid, id, score): inner product of map<index, weight> vectors; rows that share no index with the query are no hits."""
    q = queries.select("qid", F.explode("qvector").alias("ix", "qw"))
    each = rows.select(F.col(id_col).alias("id"), F.explode(vector).alias("ix", "w"))
    return each.join(F.broadcast(q), "ix").groupBy("qid", "id").agg(F.sum(F.col("w").cast("double") * F.col("qw").cast("double")).alias("score"))


def sparse_ip(rows: DataFrame, queries: DataFrame, k: int = 10, *, vector: str = "sparse", id_col: str = "id", offset: int = 0) -> DataFrame:
    """(qid, id, score, rank): the best rows by ``sparse_scores``."""
    return top_k(sparse_scores(rows, queries, vector=vector, id_col=id_col), [F.col("score").desc(), F.col("id").asc()], k, offset)
