"""Shared pieces of the training-data operators: scratch tables, skew-safe lookups,
connected components and a columnar shuffle."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A value that at least one row in HOT_SHARE has is hot; there are at most HOT_SHARE such values.
HOT_SHARE = 1000
#: Above so many edges components are found by distributed star contraction instead of on the driver.
DRIVER_EDGES = 1_000_000
#: Bytes of the largest table that is broadcast after its size was measured.
BROADCAST_BYTES = 16 << 20
#: Bytes of a bucket of a table that is joined several times.
BUCKET = 64 << 20


def bounded_batches(spark: SparkSession, rows: int = 512, size: int = 8 << 20) -> None:
    """Keeps Arrow batches small, in rows and in bytes: one with very long texts still fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def trim() -> None:
    """Hands memory that a task has freed back to the system: workers live on, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset in local mode, a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="orrery-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return f"file://{_own['dir']}"


def table(df: DataFrame, among: list[str] | None = None, by: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, survives lost executors.

    ``among`` takes its folder, for ``discard``; the values of ``by`` get folders of their own, so that a filter on it reads no others.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    if among is not None:
        among.append(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, size: int, among: list[str]) -> DataFrame:
    """``df``, which a shuffle has partitioned by ``key``, in buckets of about BUCKET bytes of its ``size``: joins on the key move the other side only."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = parts * max(1, -(-size // (BUCKET * parts)))  # a multiple, so that a task writes whole buckets
    name, path = f"orrery_{uuid.uuid4().hex}", f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    among += [name, path]
    df.write.bucketBy(n, key).sortBy(key).option("compression", "zstd").option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def discard(spark: SparkSession, among: list[str]) -> None:
    """Removes scratch tables that nothing reads any more."""
    for x in among:
        if "/" not in x:
            spark.sql(f"DROP TABLE IF EXISTS {x}")
            continue
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x)  # noqa: SLF001
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)  # noqa: SLF001
    among.clear()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go when the write or action that made them ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def likely(keys: DataFrame, most_bits: int = 1 << 27) -> Callable[[Column], Column]:
    """Whether a digest may be among ``keys`` (one column of digests of 16 bytes), by a Bloom filter of bounded size; never false for one that is."""
    spark = keys.sparkSession
    bits = min(most_bits, 1 << max(13, (32 * keys.count()).bit_length()))

    def places(digests: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(digests), dtype="<u8") % np.uint64(bits)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.zeros(bits, dtype=bool)
        for b in batches:
            field[places(b.column(0).to_pylist())] = True
        yield pa.record_batch([pa.array([np.packbits(field).tobytes()], pa.binary())], names=["b"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.zeros(bits // 8, dtype=np.uint8)
        for b in batches:
            for x in b.column(0).to_pylist():
                field |= np.frombuffer(x, dtype=np.uint8)
        yield pa.record_batch([pa.array([field.tobytes()], pa.binary())], names=["b"])

    field = np.zeros(bits // 8, dtype=np.uint8)
    for r in keys.mapInArrow(mark, "b binary").repartition(4).mapInArrow(merge, "b binary").collect():
        field |= np.frombuffer(r.b, dtype=np.uint8)
    shared = spark.sparkContext.broadcast(field)

    @F.pandas_udf("boolean")
    def test(digest):  # noqa: ANN001, ANN202
        import pandas as pd

        k = places(digest.tolist())
        hit = (shared.value[(k >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (k & np.uint64(7))).astype(np.uint8)) & 1
        return pd.Series(hit.reshape(-1, 2).all(axis=1))

    return test


def lookup(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``left`` joined with ``right``, whose ``key`` is unique, safe where a few keys hold most rows.

    Keys that hold at least 1/HOT_SHARE of the left rows are at most HOT_SHARE many, so the right
    rows of these are broadcast; all other keys are joined by a shuffle. ``left`` is read twice:
    pass a table that is cheap to read. Null keys match nothing.
    """
    n = left.count()
    hot = [r[0] for r in left.groupBy(key).count().where(F.col(key).isNotNull() & (F.col("count") >= max(n / HOT_SHARE, 10_000))).select(key).collect()]
    if not hot:
        return left.join(right, key, how)
    spark = left.sparkSession
    marks = spark.createDataFrame([(k,) for k in hot], right.select(key).schema).withColumn("_hot", F.lit(True))
    tagged = left.join(F.broadcast(marks), key, "left")
    cold = tagged.where(F.col("_hot").isNull()).drop("_hot").join(right, key, how)
    few = right.join(F.broadcast(marks.drop("_hot")), key, "left_semi")
    return cold.unionByName(tagged.where("_hot").drop("_hot").join(F.broadcast(few), key, how))


def sized_broadcast(df: DataFrame, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its measured size allows that, else as it is (joined by a shuffle)."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df


def _union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component); ``a`` and ``b`` are the ends of the edges."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = np.minimum(new, new[new])
        while not np.array_equal(new, nxt := new[new]):
            new = nxt
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def components(edges: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(node, component) for the nodes of the undirected ``edges`` (a, b longs); component: its smallest node.

    Few edges (measured) are joined up on the driver, any more by alternating large-star and
    small-star contraction with the edge list written after every round.
    """
    spark = edges.sparkSession
    edges = table(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if edges.limit(driver_edges + 1).count() <= driver_edges:
        pdf = edges.toPandas()
        if pdf.empty:
            return spark.createDataFrame([], "node long, component long")
        nodes, label = _union_find(pdf.a.to_numpy(), pdf.b.to_numpy())
        return spark.createDataFrame(pa.table({"node": nodes, "component": label}))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    last = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = table(lookup(table(both), low, "a").where("b > a").select(F.col("m").alias("a"), F.col("b")).where("a != b").distinct())
        big = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(low, "a").select("m", "b", "a")
        edges = table(small.select(F.col("m").alias("a"), F.col("b")).union(small.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    return nodes.join(edges.groupBy("b").agg(F.min("a").alias("m")), F.col("node") == F.col("b"), "left").select("node", F.coalesce("m", "node").alias("component"))


class Scatter:
    """Collects numpy records of one task and hands them out as Arrow rows (bucket, payload).

    A columnar shuffle: the JVM moves one binary per bucket and flush, not one row per record.
    """

    SCHEMA = "bucket int, payload binary"
    ARROW = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])

    def __init__(self, buckets: int, flush: int = 16 << 20, combine: Callable[[np.ndarray], np.ndarray] | None = None):
        self.buckets, self.flush, self.combine = buckets, flush, combine
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, records: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Takes records whose field ``h`` (uint64) decides the bucket."""
        if len(records):
            self.held.append(records)
            self.size += records.nbytes
            if self.size >= self.flush:
                yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        r = np.concatenate(self.held)
        self.held, self.size = [], 0
        if self.combine:
            r = self.combine(r)
        b = ((r["h"] >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int32)
        order = np.argsort(b, kind="stable")
        r, b = r[order], b[order]
        cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1], True])
        ids, blobs, held = [], [], 0
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
            ids.append(b[i])
            blobs.append(r[i:j].tobytes())
            held += len(blobs[-1])
            if held > 8 << 20:
                yield pa.record_batch([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], schema=self.ARROW)
                ids, blobs, held = [], [], 0
        if ids:
            yield pa.record_batch([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], schema=self.ARROW)
        trim()


def records(payload: pa.ChunkedArray | pa.Array, dtype: np.dtype) -> np.ndarray:
    """The records of one bucket's payloads."""
    chunks = payload.chunks if isinstance(payload, pa.ChunkedArray) else [payload]
    parts = [np.frombuffer(x.as_buffer(), dtype=dtype) for c in chunks for x in c]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=dtype)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
