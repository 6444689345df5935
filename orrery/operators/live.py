"""Visible rows of a mutation log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_rows(data: DataFrame, deletes: DataFrame | None, pk: str, partitions: list[str] | None = None, upto: int | None = None) -> DataFrame:
    """The newest row of each key, unless a tombstone has a larger ``_seq``.

    data: the columns of the collection with ``_seq`` and ``_partition``; deletes: (pk, _seq). ``partitions`` limits the rows that are
    looked at (a key whose newer version lies elsewhere still shows its newest version here); tombstones hold for all
    partitions. ``upto`` reads the log as it was at that ``_seq``. The newest row comes from a partial and a final aggregate,
    both by sorting, as whole rows are what they keep; tombstones are aggregated to one per key before the join.
    """
    if partitions is not None:
        data = data.where(F.col("_partition").isin(partitions))
    if upto is not None:
        data = data.where(F.col("_seq") <= upto)
    newest = data.groupBy(pk).agg(F.max_by(F.struct(*data.columns), F.col("_seq")).alias("_row")).select("_row.*")
    if deletes is None:
        return newest
    return without_deleted(newest, deletes if upto is None else deletes.where(F.col("_seq") <= upto), pk)


def without_deleted(rows: DataFrame, deletes: DataFrame, pk: str) -> DataFrame:
    """``rows`` without those that a tombstone with a larger ``_seq`` hides."""
    last = deletes.groupBy(F.col(pk).alias("_pk")).agg(F.max("_seq").alias("_dseq"))
    return rows.join(last, (F.col(pk) == F.col("_pk")) & (F.col("_dseq") > F.col("_seq")), "left_anti")


def tombstone_watermark(data: DataFrame, deletes: DataFrame) -> DataFrame:
    """The tombstones that still can hide a row: those above the smallest ``_seq`` of the data."""
    low = data.agg(F.min("_seq").alias("_low"))
    return deletes.join(F.broadcast(low), F.col("_seq") > F.col("_low")).drop("_low")


def overlay(live: DataFrame, changes: DataFrame, pk: str, columns: list[str]) -> DataFrame:
    """Partial upsert: ``changes`` completed from the live rows with the same key.

    Columns that ``changes`` lacks come from the live row (null for new keys); a column that it has wins even where it is null.
    """
    old = live.select(F.col(pk).alias("_old_pk"), *[F.col(f"`{c}`").alias(f"_old_{c}") for c in columns if c not in changes.columns])
    joined = changes.join(old, F.col(pk) == F.col("_old_pk"), "left")
    return joined.select(*[F.col(f"`{c}`") if c in changes.columns else F.col(f"`_old_{c}`").alias(c) for c in columns])
