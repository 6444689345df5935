"""Sharding by sampled splitters.

Rows are ordered by (hash of the text, doc_id, a number of the row), so equal texts stand together but a group of any size, even of
rows that agree in everything, can be split. A size-weighted sample of keys gives quantile splitters, rows are range-partitioned between
them, ranges that turn out overfull are subdivided by a sample of their own, and exact prefix
sums over the ranges cut the order into shards of nearly equal bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import bounded_batches, table

#: Ranges at first: one for a million rows, between these bounds, so that the splitters stay a bounded list. Sampled keys for each of them.
RANGES = 256
MOST_RANGES = 8192
RANGE_ROWS = 1_000_000
SAMPLES = 16
#: A range with more than so many times the mean bytes is subdivided.
OVERFULL = 2.0
#: A row larger than 1/LARGE of a shard is placed on its own; there are at most LARGE * shards such rows.
LARGE = 128
OVERHEAD = 16


Key = tuple[int, int, int]


def _code(*parts: np.ndarray) -> np.ndarray:
    """Keys (hash, id, number) as byte strings that sort alike."""
    flip = np.uint64(1 << 63)
    both = np.stack([x.astype(np.int64).view(np.uint64) ^ flip for x in parts], axis=1).astype(">u8")
    return np.ascontiguousarray(both).view("V24").ravel()


def _below(edges: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each key the number of sorted ``edges`` that are not above it."""
    both = np.concatenate([edges, keys]).view(">u8").reshape(-1, 3)
    _, place = np.unique(both, axis=0, return_inverse=True)
    return np.searchsorted(place.ravel()[: len(edges)], place.ravel()[len(edges) :], side="right").astype(np.int32)


def _sample(rows: DataFrame, n: int) -> list[Key]:
    """At most ``n`` keys (h, d, r): an exponential-key sample without replacement, weighted by size."""
    u = (F.pmod(F.xxhash64("h", "d", "r", F.lit(7)), F.lit(1 << 40)) + 1) / F.lit(float((1 << 40) + 1))
    return [tuple(r) for r in rows.select("h", "d", "r", (-F.log(u) / F.col("size")).alias("e")).orderBy("e", "h", "d", "r").limit(n).select("h", "d", "r").collect()]


def _quantiles(sample: list[Key], n: int) -> list[Key]:
    """n - 1 splitters at most: quantile keys of a sample that is already weighted by size."""
    keys = sorted(sample)
    return sorted({keys[len(keys) * i // n] for i in range(1, n)}) if keys else []


def _ranged(rows: DataFrame, splitters: list[Key]) -> DataFrame:
    """``rows`` with their range (number of splitters not above the key)."""
    if not splitters:
        return rows.withColumn("range", F.lit(0))
    edges = _code(*np.array(splitters, dtype=np.int64).T)

    @F.pandas_udf("int")
    def find(h, d, r):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(_below(edges, _code(h.to_numpy(), d.to_numpy(), r.to_numpy())))

    return rows.withColumn("range", find("h", "d", "r"))


def splitters(rows: DataFrame, ranges: int = RANGES, samples: int = SAMPLES) -> list[Key]:
    """Splitters of the keys (h, d, r) of ``rows`` (h, d, r, size) into ranges none of which is overfull."""
    cut = _quantiles(_sample(rows, ranges * samples), ranges)
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    for _ in range(8):
        r = _ranged(rows, cut)
        sizes = r.groupBy("range").agg(F.sum("size").alias("s"), F.count("*").alias("k")).where((F.col("s") > OVERFULL * total / ranges) & (F.col("k") > 1)).collect()
        add: set[Key] = set()
        for x in sizes:  # at most ranges / OVERFULL of them
            own = r.where(F.col("range") == x["range"])
            parts = int(np.ceil(x["s"] * ranges / total))
            add |= set(_quantiles(_sample(own, parts * samples), parts))
        if not add - set(cut):
            break
        cut = sorted(set(cut) | add)
    return cut


def shard(docs: DataFrame, shards: int = 40, row: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs`` (doc_id, text): law ``bytes``.

    size: UTF-8 bytes of the text (null: none) plus 16; text_crc32 of a null text is that of the
    empty one. Shards differ in bytes by about 1/LARGE of a shard at most, except where one row is larger
    than a shard. Slots count from 0 in each shard. Equal texts are neighbours wherever no shard ends between
    them. Rows that repeat entirely are kept, each with its own slot; a null id sorts first. ``row`` names a long column that
    tells rows apart, and comes with the result as ``r``.
    """
    bounded_batches(docs.sparkSession, 10_000)
    key = F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63)))
    rows = table(docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.xxhash64("text").alias("h"), key.alias("d"), (F.col(row) if row else F.monotonically_increasing_id()).alias("r")))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bound = max(1, total // (shards * LARGE))
    big = rows.where(F.col("size") > bound)  # at most shards * LARGE rows: each holds more than 1/(shards * LARGE) of the bytes
    loads = np.zeros(shards, dtype=np.int64)
    counts = np.zeros(shards, dtype=np.int64)
    placed = []
    for r in sorted(big.collect(), key=lambda r: (-r["size"], r["h"], r["d"], r["r"])):
        s = int(loads.argmin())
        placed.append((r["doc_id"], r["size"], r["text_crc32"], s, int(counts[s]), r["r"]))
        loads[s] += r["size"]
        counts[s] += 1
    spark = docs.sparkSession
    kind = rows.schema["doc_id"].dataType.simpleString()
    large = spark.createDataFrame(placed, f"doc_id {kind}, size long, text_crc32 long, shard int, slot long, r long")

    small = rows.where(F.col("size") <= bound)
    ranged = table(_ranged(small, splitters(small, min(MOST_RANGES, max(RANGES, rows.count() // RANGE_ROWS)))))
    # what each shard may still take; prefix sums of it are the shard ends in the order of the keys
    rest = int(total - loads.sum())
    level = _level(loads, rest)
    room = np.maximum(level - loads, 0)
    ends = np.cumsum(room) * (rest / max(1, room.sum()))
    per = {r["range"]: (r["s"], r["n"]) for r in ranged.groupBy("range").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()}
    before, b = {}, 0
    for k in sorted(per):
        before[k] = b
        b += per[k][0]
    starts = spark.createDataFrame([(k, v) for k, v in before.items()], "range int, before long")
    w = Window.partitionBy("range").orderBy("h", "d", "r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = ranged.join(F.broadcast(starts), "range").withColumn("upto", F.sum("size").over(w) + F.col("before"))
    held = spark.sparkContext.broadcast(ends)

    @F.pandas_udf("int")
    def of(upto, size):  # noqa: ANN001, ANN202
        import pandas as pd

        e = held.value
        return pd.Series(np.minimum(np.searchsorted(e, upto.to_numpy() - size.to_numpy() / 2, side="left"), len(e) - 1).astype(np.int32))

    cut = table(run.withColumn("shard", of("upto", "size")))
    base = cut.groupBy("shard", "range").agg(F.count("*").alias("n")).collect()  # at most ranges + shards rows
    first, seen = [], dict(enumerate(counts.tolist()))
    for r in sorted(base, key=lambda r: (r["shard"], r["range"])):
        first.append((r["shard"], r["range"], seen[r["shard"]]))
        seen[r["shard"]] += r["n"]
    at = spark.createDataFrame(first, "shard int, range int, first long")
    slots = cut.join(F.broadcast(at), ["shard", "range"]).withColumn("slot", F.row_number().over(Window.partitionBy("range", "shard").orderBy("h", "d", "r")) - 1 + F.col("first"))
    out = slots.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"), "r").unionByName(large)
    return out if row else out.drop("r")


def _level(loads: np.ndarray, rest: int) -> float:
    """The level to which ``rest`` more bytes fill the loads, lowest first."""
    x = np.sort(loads).astype(float)
    for k in range(1, len(x) + 1):
        level = (x[:k].sum() + rest) / k
        if k == len(x) or level <= x[k]:
            return level
    return 0.0


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> None:
    """Writes every row of ``docs`` once, with its shard as a partition column ``shard`` and its place in it as ``slot``; columns of these names are replaced.

    Rows are numbered in a written copy first, so null ids and repeated rows keep the shards that were counted for them.
    """
    held = table(docs.select(F.struct(*docs.columns).alias("row"), docs["doc_id"], docs["text"], F.monotonically_increasing_id().alias("r")))
    where = shard(held, shards, "r").select("r", "shard", "slot")
    rows = held.select("row", "r").join(where, "r")
    placed = rows.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot")
    placed.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in ("shard", "slot")], "shard", "slot").write.partitionBy("shard").parquet(path)
