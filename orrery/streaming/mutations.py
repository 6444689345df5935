"""Structured Streaming into a collection, and the live view of a stream of mutations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orrery.sources.store import Collection


def apply_mutations(stream: DataFrame, collection: Collection, checkpoint: str, op: str = "_op", **trigger: object) -> StreamingQuery:
    """Writes a stream of rows, ``op`` being ``upsert`` or ``delete``, into ``collection``, every micro-batch once.

    The number of the last batch is part of the state that makes its rows count, so a batch that is replayed after a
    crash, wherever that was, is skipped or written whole. Within a batch deletes come after upserts of the same key.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            rows = batch.where(F.col(op) == "upsert").drop(op)
            gone = batch.where(F.col(op) == "delete").select(collection.pk)
            collection.apply(None if rows.isEmpty() else rows, None if gone.isEmpty() else gone, number)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def latest_state(stream: DataFrame, pk: str, seq: str, op: str, value: str) -> DataFrame:
    """(pk, seq, op, value): a row for each mutation that is newer than all seen of its key; late ones change nothing.

    pk, seq: longs; op, value: strings. The state of a key is the largest ``seq`` seen.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: object) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        best = None
        for b in batches:
            b = b.sort_values(seq)
            if len(b) and (best is None or b[seq].iloc[-1] > best[seq].iloc[0]):
                best = b.tail(1)
        if best is not None and (last is None or best[seq].iloc[0] > last):
            state.update((int(best[seq].iloc[0]),))
            yield best[[pk, seq, op, value]]

    rows = stream.select(F.col(pk).cast("long").alias(pk), F.col(seq).cast("long").alias(seq), F.col(op).alias(op), F.col(value).cast("string").alias(value))
    return rows.groupBy(pk).applyInPandasWithState(step, f"{pk} long, {seq} long, {op} string, {value} string", "seq long", "update", "NoTimeout")
