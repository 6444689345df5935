"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import decontam, langid, ngram_join, packing, pii
from orrery.llm.common import BROADCAST_BYTES, likely, lookup, scratch_dir, shuffles_removed, sized_broadcast, table

#: The first stage is a fitted classifier and the last a tokenizer, so no SQL gives these rows; tests hold the stages against brute force.
ORACLE_SQL: str | None = None

#: A prediction below this posterior is a rejection.
MIN_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language was recognised; rejected are those without a letter (or text) and uncertain ones."""
    found = langid.identify(docs, langid.fit(docs), [*docs.columns])
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group that n-gram Jaccard links join: that of the smallest doc_id (null last), then text digest.

    Rows are told apart by id and text, so ids may repeat or be null; of rows that agree in both the least in all columns
    stays. Documents without words link with nothing and stay.
    """
    with shuffles_removed(spark):
        found = table(ngram_join.similar_sets(docs, rows_too=True).where("group IS NOT NULL").select("group", "doc_id", "digest"))
        rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
        several = found.groupBy("group").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").select("group", "first")
        ranked = table(lookup(found, table(several), "group", "inner").select(ngram_join.row_id(F.col("doc_id")).alias("_d"), F.col("digest").alias("_t"), rank.eqNullSafe(F.col("first")).alias("kept")))
        gone = table(ranked.where("NOT kept").select("_d", "_t").distinct())
        repeated = table(ranked.where("kept").groupBy("_d", "_t").count().where("count > 1").select("_d", "_t"))
    keyed = docs.withColumns({"_d": ngram_join.row_id(docs["doc_id"]), "_t": ngram_join.text_digest(docs["text"])})
    if gone.count() * 40 <= BROADCAST_BYTES:
        kept = keyed.join(sized_broadcast(gone, 40), ["_d", "_t"], "left_anti")
    else:  # a text that surely stays does not move
        maybe = likely(gone.select("_t"))(F.col("_t"))
        kept = keyed.where(~maybe).unionByName(keyed.where(maybe).join(gone, ["_d", "_t"], "left_anti"))
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    one = F.min(F.struct(*docs.columns)).alias("row")
    twice = kept.join(sized_broadcast(repeated, 40), ["_d", "_t"], "left_semi").groupBy("_d", "_t").agg(one).select("row.*")
    return kept.join(sized_broadcast(repeated, 40), ["_d", "_t"], "left_anti").select(*docs.columns).unionByName(twice)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that benchmark passages make up a twentieth of or more, and cuts the passages out of the others."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets in the texts by their kind."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into token sequences, one row a piece with its ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
