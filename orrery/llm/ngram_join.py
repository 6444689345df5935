"""Exact Jaccard join of word n-gram sets by set-relation skipping.

Equal sets are one set with a count: their answers are the same. Each distinct set is indexed under the
rarest grams of its prefix (two linked sets share one of those). Index lists are ordered by size and
carry positions, kept in blocks with the best position of each: a block from which nothing can reach the required overlap is skipped whole.
Highly similar sets are gathered in balls around a first set: a ball is indexed once, and its members are kept as
differences to the first set. Two balls are compared by the overlap of their first sets; every other overlap is derived from that
answer by adding and taking off what the differences have in common with the other side, without the sets themselves. Only counts and a
spanning forest leave a comparison of two balls, never all pairs.
A shared gram says little about balls of a large table. So pairs first meet as bitmaps, a bit or two for each gram, which bound
the overlap from above; sets are fetched for the balls of the pairs that this leaves, which are nearly all linked.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import BROADCAST_BYTES, Scatter, _union_find, bounded_batches, components, discard, likely, lookup, records, shuffles_removed, sized_broadcast, table, trim
from orrery.llm.textbytes import mix, pieces, shingle_sets

GRAM = 5
#: Linked: NUM * union <= DEN * intersection.
NUM, DEN = 80, 100
#: Cells of the frequency sketch: fixed, whatever the data.
CELLS = 1 << 22
_BLOCKS = 64
#: A ball takes so many sets, or so many grams in all; further ones start another ball.
BALL_SETS = 128
BALL_GRAMS = 1 << 20
BUCKET_BYTES = 8 << 20
#: An index list of more balls is split: its balls are dealt to blocks and each two blocks meet in a task of their own.
HOT_LIST = 100_000
#: Postings in a block of an index list.
SKIP = 32
_LEAST = -(1 << 63)

_POST = np.dtype([("h", "<u8"), ("ball", "<i8"), ("lo", "<i4"), ("hi", "<i4"), ("pos", "<i4")])


def prefix_length(n: int) -> int:
    """Grams of a set of ``n`` that may hold the first one shared with a linked set."""
    return n - -(-NUM * n // DEN) + 1


def bitmap(s: np.ndarray) -> bytes:
    """One to two bits for each gram of a set, 64 at least; the low bits of a gram say which is set."""
    bits = np.zeros(max(64, 1 << (len(s) - 1).bit_length()), dtype=np.uint8)
    bits[(s & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(raw: bytes, size: int) -> int:
    """A bitmap as a number, its halves laid over each other down to ``size`` bytes."""
    x, n = int.from_bytes(raw, "little"), len(raw)
    while n > size:
        n //= 2
        x = x >> 8 * n | x & (1 << 8 * n) - 1
    return x


def may_link(a: tuple[int, int, bytes, bytes], b: tuple[int, int, bytes, bytes]) -> bool:
    """Whether a set of ball ``a`` can be linked with one of ``b``; false only where none is.

    A ball is (smallest size, largest size, bits that all of its sets have, bits that any of them has). Each bit that all of ``a``
    have and none of ``b`` stands for another gram that a set of ``a`` does not share, and the other way round.
    """
    size = min(len(a[3]), len(b[3]))
    p = (folded(a[2], size) & ~folded(b[3], size)).bit_count()
    q = (folded(b[2], size) & ~folded(a[3], size)).bit_count()
    both = DEN + NUM  # linked sets of x and y grams share NUM * (x + y) / both at least, and x - p, y - q at most
    return DEN * a[1] - NUM * b[0] >= both * p and DEN * b[1] - NUM * a[0] >= both * q and (DEN - NUM) * (a[1] + b[1]) >= both * (p + q)


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(row_id(docs["doc_id"]).alias("d"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def _rows(docs: DataFrame) -> DataFrame:
    """``_source`` with the digest of the text: the two tell rows apart."""
    return _source(docs).withColumn("digest", text_digest(F.col("text")))


def row_id(doc_id: Column) -> Column:
    """The id as a long that is never null."""
    return F.coalesce(doc_id.cast("long"), F.lit(_LEAST))


def text_digest(text: Column) -> Column:
    """Tells texts apart; a null one counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _survey(docs: DataFrame) -> DataFrame:
    """Per row (d, key, n, m1, digest of the text), and per task the counts of its distinct sets' grams by cell (block, counts)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, dtype=np.uint32)
        seen: set[bytes] = set()
        names = ["d", "key", "n", "m1", "block", "counts", "digest"]
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        for b in batches:
            keys, ns, m1 = [], [], []
            for _, _, data, off in pieces(b.column(1)):
                for s in shingle_sets(data, off, GRAM):
                    k = _digest(s)
                    keys.append(k)
                    ns.append(len(s))
                    m1.append(int(s[:1].view(np.int64)[0]) if len(s) else None)
                    if k not in seen:
                        seen.add(k)
                        np.add.at(cells, (s >> np.uint64(42)).astype(np.int64), 1)
            nothing = [None] * len(ns)
            yield pa.record_batch([b.column(0), *(pa.array(x, t) for x, t in zip((keys, ns, m1, nothing, nothing), kinds[1:])), b.column(2)], names=names)
        if seen:
            rows = [np.minimum(x, 65535).astype("<u2").tobytes() for x in cells.reshape(_BLOCKS, -1)]
            nothing = [None] * _BLOCKS
            yield pa.record_batch([pa.array(x, t) for x, t in zip((nothing, nothing, nothing, nothing, list(range(_BLOCKS)), rows, nothing), kinds)], names=names)
        del cells
        trim()

    return _rows(docs).mapInArrow(scan, "d long, key binary, n int, m1 long, block int, counts binary, digest binary")


def _levels(parts: DataFrame) -> np.ndarray:
    """The sketch: for each cell the binary logarithm of its count; partial counts are added in two rounds on the executors."""

    def adder(kind: str):  # noqa: ANN202
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    x = np.frombuffer(raw, dtype=kind).astype(np.int64)
                    total[k] = total[k] + x if k in total else x
            for k, x in total.items():
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([x.astype("<i8").tobytes()], pa.binary())], names=["block", "counts"])

        return add

    schema = "block int, counts binary"
    once = parts.select("block", "counts").repartition(F.col("block"), F.spark_partition_id() % 32).mapInArrow(adder("<u2"), schema)
    got = once.repartition("block").mapInArrow(adder("<i8"), schema)

    def log(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [np.log2(np.frombuffer(x, dtype="<i8") + 1).astype(np.uint8).tobytes() for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(raw, pa.binary())], names=["block", "counts"])

    out = np.zeros((_BLOCKS, CELLS // _BLOCKS), dtype=np.uint8)
    for r in got.mapInArrow(log, schema).collect():  # 4 MB in all
        out[r["block"]] = np.frombuffer(r["counts"], dtype=np.uint8)
    return out.ravel()


def _prefixes(docs: DataFrame, levels: np.ndarray, hot: dict[int, int]) -> DataFrame:
    """(bucket, key, n, low, prefix, bits) of each task's distinct sets: its smallest hashes, its rarest grams in order and its bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast((levels, hot))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, salts = shared.value
        seen: set[bytes] = set()
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for _, _, data, off in pieces(b.column(1)):
                for s in shingle_sets(data, off, GRAM):
                    if not len(s) or (k := _digest(s)) in seen:
                        continue
                    seen.add(k)
                    m1 = int(s[:1].view(np.int64)[0])
                    order = np.argsort(level[(s >> np.uint64(42)).astype(np.int64)], kind="stable")[: prefix_length(len(s))]
                    salt = int.from_bytes(k[:4], "little") % salts.get(m1, 1)
                    cols[0].append((m1 + salt * 0x9E3779B97F4A7C1 + 2**63) % 2**64 - 2**63)
                    cols[1].append(k)
                    cols[2].append(len(s))
                    cols[3].append((s[:32] >> np.uint64(32)).astype("<u4").tobytes())
                    cols[4].append(s[order].tobytes())
                    cols[5].append(bitmap(s))
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=["bucket", "key", "n", "low", "prefix", "bits"])
        del seen
        trim()

    return _source(docs).mapInArrow(scan, "bucket long, key binary, n int, low binary, prefix binary, bits binary")


def _balls(prefixes: DataFrame) -> DataFrame:
    """(ball, keys, lo, hi, grams, places, common, bits): sets that share their smallest hash and most of the next ones, at most BALL_SETS together.

    bits has the bits that any of its sets has; common those that all have, null if these are the same.

    Which sets share a ball decides the amount of work only. Copies of a set from several tasks meet in one bucket
    and become one.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId() << 33, 0
        seen: set[bytes] = set()
        open_: dict[int, list[list]] = {}
        held = 0

        def out(balls: list[list]) -> pa.RecordBatch:
            nonlocal made
            cols: list[list] = [[], [], [], [], [], [], [], []]
            for _, keys, ns, prefixes, _, maps in balls:
                g = np.concatenate(prefixes)
                pos = np.concatenate([np.arange(len(x)) for x in prefixes])
                order = np.lexsort((pos, g))
                g, pos = g[order], pos[order]
                first = np.r_[True, g[1:] != g[:-1]]
                size = min(map(len, maps))
                every = {folded(x, size) for x in maps}
                common, bits = (f(every).to_bytes(size, "little") for f in (lambda z: reduce(and_, z), lambda z: reduce(or_, z)))
                for c, v in zip(cols, (part + made, keys, min(ns), max(ns), g[first].tobytes(), pos[first].astype("<i4").tobytes(), None if common == bits else common, bits)):
                    c.append(v)
                made += 1
            kinds = (pa.int64(), pa.list_(pa.binary()), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=["ball", "keys", "lo", "hi", "grams", "places", "common", "bits"])

        for b in batches:
            full = []
            for bucket, key, n, low, prefix, bits in zip(*(b.column(i).to_pylist() for i in range(6))):
                if key in seen:
                    continue
                seen.add(key)
                low = set(np.frombuffer(low, dtype="<u4").tolist())
                held += len(prefix) + len(bits)
                mine = open_.setdefault(bucket, [])
                for ball in mine[-4:]:
                    if 5 * n >= 4 * ball[2][0] and 4 * n <= 5 * ball[2][0] and 2 * len(low & ball[0]) >= len(ball[0]):
                        ball[1].append(key)
                        ball[2].append(n)
                        ball[3].append(np.frombuffer(prefix, dtype="<u8"))
                        ball[4] += n
                        ball[5].append(bits)
                        if len(ball[1]) >= BALL_SETS or ball[4] >= BALL_GRAMS:
                            mine.remove(ball)
                            full.append(ball)
                        break
                else:
                    mine.append([low, [key], [n], [np.frombuffer(prefix, dtype="<u8")], n, [bits]])
            if full:
                yield out(full)
            if held > 48 << 20:
                yield out([x for m in open_.values() for x in m])
                open_, held = {}, 0
        rest = [x for m in open_.values() for x in m]
        for i in range(0, len(rest), 2000):
            yield out(rest[i : i + 2000])
        del rest, open_, seen
        trim()

    return prefixes.repartition("bucket").mapInArrow(build, "ball long, keys array<binary>, lo int, hi int, grams binary, places binary, common binary, bits binary")


def _hot_grams(balls: DataFrame, size: int) -> dict[int, int]:
    """Blocks for each gram under which more than HOT_LIST balls stand (or a millionth of all postings, if that is more).

    A task reports a gram that has half that share of its own postings. If a gram has the whole share, then the tasks that don't
    report it hold less than half of its postings, so half the limit is always reported; at most two million grams are hot.
    """
    limit = max(HOT_LIST, size // 1_000_000)
    share = limit / max(size, 1) / 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros(0, dtype=np.uint64)
        n = np.zeros(0, dtype=np.int64)
        total = 0
        held: list[np.ndarray] = []

        def fold() -> None:
            nonlocal grams, n
            new = np.concatenate(held) if held else np.zeros(0, dtype=np.uint64)
            held.clear()
            both, at = np.unique(np.concatenate([grams, new]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, np.ones(len(new), dtype=np.int64)]), len(both)).astype(np.int64)
            keep = n > share * total / 2  # what is dropped here and seen again later may be reported too low, by half its share at most
            grams, n = both[keep], n[keep]

        for b in batches:
            for raw in b.column(0).to_pylist():
                held.append(np.frombuffer(raw, dtype="<u8"))
                total += len(held[-1])
            if sum(map(len, held)) > 1 << 21:
                fold()
        fold()
        keep = n >= max(2, share * total / 2)
        yield pa.record_batch([pa.array(grams[keep].view(np.int64)), pa.array(n[keep])], names=["gram", "n"])

    found = balls.select("grams").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= limit / 4).collect()
    return {r["gram"] & (1 << 64) - 1: math.ceil(4 * r["n"] / HOT_LIST) for r in found}


def _candidates(balls: DataFrame, buckets: int, hot: dict[int, int]) -> DataFrame:
    """(a, b), a < b: balls that share a prefix gram and whose sizes and positions leave room for a link."""
    order = sorted(hot)
    shared = balls.sparkSession.sparkContext.broadcast((np.array(order, dtype=np.uint64), np.array([hot[g] for g in order], dtype=np.int64)))

    def split(r: np.ndarray, grams: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Postings of hot grams go to each pair of blocks that theirs belongs to."""
        k = np.minimum(np.searchsorted(grams, r["h"]), len(grams) - 1)
        is_hot = grams[k] == r["h"]
        if not is_hot.any():
            return r
        h, s = r[is_hot], blocks[k[is_hot]]
        own = (mix(h["ball"].astype(np.uint64)) % s.astype(np.uint64)).astype(np.int64)
        copies = np.repeat(h, s)
        own, width = np.repeat(own, s), np.repeat(s, s)
        other = np.arange(len(copies)) - np.repeat(np.cumsum(s) - s, s)
        pair = np.minimum(own, other) * width + np.maximum(own, other) + 1
        copies["h"] = mix(copies["h"] + pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return np.concatenate([r[~is_hot], copies])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Scatter(buckets)
        hot_grams, blocks = shared.value
        for b in batches:
            for ball, lo, hi, grams, places in zip(*(b.column(i).to_pylist() for i in range(5))):
                g = np.frombuffer(grams, dtype="<u8")
                r = np.empty(len(g), dtype=_POST)
                r["h"], r["ball"], r["lo"], r["hi"], r["pos"] = g, ball, lo, hi, np.frombuffer(places, dtype="<i4")
                yield from out.add(split(r, hot_grams, blocks) if len(hot_grams) else r)
        yield from out.out()

    def match(t: pa.Table) -> pa.Table:
        r = records(t.column("payload"), _POST)
        r = r[np.argsort(r["h"], kind="stable")]
        at = np.flatnonzero(np.r_[True, r["h"][1:] != r["h"][:-1]]) if len(r) else np.zeros(0, dtype=np.int64)
        n = np.diff(np.r_[at, len(r)])
        r = r[np.repeat(n > 1, n)]
        if not len(r):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        r = r[np.lexsort((r["lo"], r["h"]))]
        h, lo, hi, pos, ball = r["h"], r["lo"].astype(np.int64), r["hi"].astype(np.int64), r["pos"].astype(np.int64), r["ball"]
        at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        n = np.diff(np.r_[at, len(r)])
        end = np.repeat(at + n, n)
        # partners stand behind in the list and are at most DEN/NUM times as large: the rest of the list is skipped at once
        reach = DEN * hi // NUM
        group = np.repeat(np.arange(len(at)), n)
        big = np.int64(1) << 32
        stop = np.minimum(end, np.searchsorted(group * big + lo, group * big + np.minimum(reach, big - 1), side="right"))
        rest = hi - pos
        # blocks of SKIP postings, whatever list they are of: the smallest size and the largest rest bound what a posting in them can share
        edge = np.arange(0, len(r), SKIP)
        least, most = np.minimum.reduceat(lo, edge), np.maximum.reduceat(rest, edge)
        begin = np.arange(len(r)) + 1
        many = np.where(stop > begin, (stop - 1) // SKIP - begin // SKIP + 1, 0)
        found = [np.zeros(0, dtype=[("a", "<i8"), ("b", "<i8")])]
        i = 0
        total = np.r_[0, np.cumsum(many)]
        while i < len(r):
            j = max(i + 1, int(np.searchsorted(total, total[i] + (1 << 16), side="right")) - 1)
            x = np.repeat(np.arange(i, j), many[i:j])
            block = np.arange(len(x)) - np.repeat(total[i:j] - total[i], many[i:j]) + begin[x] // SKIP
            # what stands behind x is not smaller than x, nor than the smallest of its block
            open_ = np.minimum(rest[x], most[block]) >= -(-NUM * (lo[x] + np.maximum(least[block], lo[x])) // (DEN + NUM))
            x, block = x[open_], block[open_]
            low, high = np.maximum(begin[x], block * SKIP), np.minimum(stop[x], (block + 1) * SKIP)
            n = high - low
            y = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            x = np.repeat(x, n)
            # at the first gram that two linked sets share, what follows it must hold the required overlap
            need = -(-NUM * (lo[x] + lo[y]) // (DEN + NUM))
            ok = (np.minimum(rest[x], rest[y]) >= need) & (ball[x] != ball[y])
            p = np.empty(int(ok.sum()), dtype=found[0].dtype)
            p["a"], p["b"] = np.minimum(ball[x[ok]], ball[y[ok]]), np.maximum(ball[x[ok]], ball[y[ok]])
            found.append(np.unique(p))
            if len(found) > 8:
                found = [np.unique(np.concatenate(found))]
            i = j
        p = np.unique(np.concatenate(found))
        del found, r, h, lo, hi, pos, rest, ball, group, total, many, stop, end, reach
        trim()
        return pa.table({"a": pa.array(p["a"]), "b": pa.array(p["b"])})

    return balls.select("ball", "lo", "hi", "grams", "places").mapInArrow(send, Scatter.SCHEMA).groupBy("bucket").applyInArrow(match, "a long, b long").distinct()


def _promising(pairs: DataFrame, balls: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of balls that their bitmaps don't rule out."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = [[(lo, hi, bits if common is None else common, bits) for lo, hi, common, bits in zip(*(b.column(i).to_pylist() for i in at))] for at in (range(2, 6), range(6, 10))]
            keep = pa.array([may_link(x, y) for x, y in zip(*sides)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(keep)

    side = lambda name: balls.select(F.col("ball").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("lo", "hi", "common", "bits")))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", *(f"{c}_{x}" for x in "ab" for c in ("lo", "hi", "common", "bits"))).mapInArrow(test, "a long, b long")


def _freeze(members: list[tuple[int, int, np.ndarray]]) -> bytes:
    """Sets of a ball as differences to the first one; a member is (id, copies, set)."""
    base = members[0][2]
    out = [np.array([len(members)], dtype="<i8").tobytes(), np.array([m[:2] for m in members], dtype="<i8").tobytes()]
    parts = [base]
    for _, _, s in members[1:]:
        parts += [np.setdiff1d(base, s, assume_unique=True), np.setdiff1d(s, base, assume_unique=True)]
    out.append(np.array([len(p) for p in parts], dtype="<i8").tobytes())
    return b"".join(out + [p.tobytes() for p in parts])


class Ball:
    """Sets as a first one and signed differences: member ``row`` has the gram (1) or lacks it (-1), against the first set."""

    def __init__(self, raw: bytes):
        m = int(np.frombuffer(raw, dtype="<i8", count=1)[0])
        ids = np.frombuffer(raw, dtype="<i8", count=2 * m, offset=8).reshape(m, 2)
        lens = np.frombuffer(raw, dtype="<i8", count=2 * m - 1, offset=8 + 16 * m)
        grams = np.frombuffer(raw, dtype="<u8", offset=8 + 16 * m + 8 * (2 * m - 1))
        self.ids, self.copies = ids[:, 0], ids[:, 1]
        self.first, self.gram = grams[: lens[0]], grams[lens[0] :]
        self.row = np.repeat(np.repeat(np.arange(1, m), 2), lens[1:])
        self.sign = np.repeat(np.tile([-1, 1], m - 1), lens[1:])
        self.sizes = lens[0] + self.summed(self.sign)

    def summed(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, x, len(self.ids)).astype(np.int64) if len(self.row) else np.zeros(len(self.ids), dtype=np.int64)


def _in(x: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Which of ``x`` the sorted set ``s`` holds."""
    return s[np.minimum(np.searchsorted(s, x), len(s) - 1)] == x


def overlaps(a: Ball, b: Ball) -> np.ndarray:
    """Intersection sizes of all sets of ``a`` with all of ``b``.

    The first sets are intersected; the first set of one side with a member of the other has that plus or minus the member's differences
    that it holds; two members have the sum of both, plus the product of the signs of the differences that they share.
    """
    small, large = (a.first, b.first) if len(a.first) < len(b.first) else (b.first, a.first)
    out = int(_in(small, large).sum()) + a.summed(a.sign * _in(a.gram, b.first))[:, None] + b.summed(b.sign * _in(b.gram, a.first))[None, :]
    if not len(a.gram) or not len(b.gram):
        return out
    grams = np.intersect1d(a.gram, b.gram)
    sides = []
    for x in (a, b):
        col = np.minimum(np.searchsorted(grams, x.gram), max(0, len(grams) - 1))
        ok = grams[col] == x.gram if len(grams) else np.zeros(len(x.gram), dtype=bool)
        order = np.argsort(col[ok], kind="stable")
        sides.append((col[ok][order], x.row[ok][order], x.sign[ok][order]))
    step = 1 << 14
    for at in range(0, len(grams), step):
        parts = []
        for (col, row, sign), x in zip(sides, (a, b)):
            i, j = np.searchsorted(col, [at, at + step])
            m = np.zeros((len(x.ids), min(step, len(grams) - at)), dtype=np.float32)
            m[row[i:j], col[i:j] - at] = sign[i:j]
            parts.append(m)
        out = out + np.rint(parts[0] @ parts[1].T).astype(np.int64)
    return out


def _compare(pairs: DataFrame) -> DataFrame:
    """(x, y, n): with y null, set x has n linked copies among the other ball's sets; else x and y are joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys, ns = [], [], []
            for i, j, pa_, pb in zip(*(batch.column(k).to_pylist() for k in range(4))):
                x = Ball(zlib.decompress(pa_))
                y = x if i == j else Ball(zlib.decompress(pb))
                ia, ca, ib, cb = x.ids, x.copies, y.ids, y.copies
                o = overlaps(x, y)
                link = DEN * o >= NUM * (x.sizes[:, None] + y.sizes[None, :] - o)
                if i == j:
                    np.fill_diagonal(link, False)
                if not link.any():
                    continue
                sides = [(ia, link @ cb)] + ([(ib, ca @ link)] if i != j else [])
                for ids, n in sides:
                    k = np.flatnonzero(n)
                    xs += ids[k].tolist()
                    ns += n[k].tolist()
                    ys += [None] * len(k)
                u, v = np.nonzero(link)
                node, low = _union_find(ia[u], ib[v])
                k = np.flatnonzero(node != low)
                xs += node[k].tolist()
                ys += low[k].tolist()
                ns += [0] * len(k)
            yield pa.record_batch([pa.array(xs, pa.int64()), pa.array(ys, pa.int64()), pa.array(ns, pa.int64())], names=["x", "y", "n"])
        trim()

    return pairs.select("a", "b", "pa", "pb").mapInArrow(run, "x long, y long, n long")


def _payloads(members: DataFrame, docs: DataFrame) -> DataFrame:
    """(ball, payload) of the balls in ``members`` (ball, nid, d, digest, copies), sets taken from one row of each again."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            ball, nid, copies = (b.column(i).to_pylist() for i in range(3))
            got = [s for _, _, data, off in pieces(b.column(3)) for s in shingle_sets(data, off, GRAM)]
            k = [i for i, x in enumerate(nid) if x not in seen and not seen.add(x)]  # equal rows are sent once by a task
            yield pa.record_batch([pa.array([ball[i] for i in k], pa.int64()), pa.array([nid[i] for i in k], pa.int64()), pa.array([copies[i] for i in k], pa.int64()), pa.array([got[i].tobytes() for i in k], pa.binary())], names=["ball", "nid", "copies", "grams"])
            del got
        trim()

    def join(t: pa.Table) -> pa.Table:
        rows = {n: (n, c, np.frombuffer(g, dtype="<u8")) for n, c, g in zip(*(t.column(x).to_pylist() for x in ("nid", "copies", "grams")))}
        return pa.table({"ball": t.column("ball").combine_chunks()[:1], "payload": pa.array([zlib.compress(_freeze([rows[n] for n in sorted(rows)]), 1)], pa.binary())})

    rows, few = _rows(docs), members.drop("key")
    if few.count() * 64 > BROADCAST_BYTES:
        rows = rows.where(likely(few.select("digest"))(F.col("digest")))  # else all texts would move to be joined
    texts = rows.join(sized_broadcast(few, 64), ["d", "digest"])
    return texts.select("ball", "nid", "copies", "text").mapInArrow(sets, "ball long, nid long, copies long, grams binary").groupBy("ball").applyInArrow(join, "ball long, payload binary")


def _answers(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(d, key, n, m1, digest, ...) for every row, and (key, n_similar, low, group) for every set that isn't empty."""
    spark = docs.sparkSession
    scratch: list[str] = []
    early: list[str] = []
    survey = table(_survey(docs))
    rows = survey.where("block IS NULL")
    real = F.when(F.col("d") != _LEAST, F.col("d"))
    per = table(rows.where("n > 0").groupBy("key").agg(F.count("*").alias("copies"), F.min(F.struct("d", "digest")).alias("row"), F.min(real).alias("least"), F.first("n").alias("n")), scratch)
    per = table(per.withColumn("nid", F.monotonically_increasing_id()), scratch)
    total = rows.count()
    crowd = rows.where("n > 0").groupBy("m1").agg(F.count_distinct("key").alias("c")).where(F.col("c") >= max(total // 1000, 10_000)).collect()  # 1000 at most
    levels = _levels(survey.where("block IS NOT NULL"))
    balls = table(_balls(_prefixes(docs, levels, {r["m1"]: math.ceil(r["c"] / 10_000) for r in crowd})), early)
    size = balls.agg(F.coalesce(F.sum(F.octet_length("places")), F.lit(0))).first()[0] // 4
    pairs = table(_candidates(balls, max(1, math.ceil(size * _POST.itemsize / BUCKET_BYTES)), _hot_grams(balls, size)), early)
    several = balls.where(F.size("keys") > 1).select(F.col("ball").alias("a"), F.col("ball").alias("b"))
    todo = table(_promising(pairs, balls).unionByName(several), scratch)
    needed = todo.select(F.explode(F.array("a", "b")).alias("ball")).distinct()
    members = table(balls.select("ball", "keys").join(needed, "ball").select("ball", F.explode("keys").alias("key")).join(per.select("key", "nid", "row.d", "row.digest", "copies"), "key"), scratch)
    discard(spark, early)
    payloads = table(_payloads(members, docs), scratch)
    first = payloads.select(F.col("ball").alias("a"), F.col("payload").alias("pa"))
    second = payloads.select(F.col("ball").alias("b"), F.col("payload").alias("pb"))
    found = table(_compare(todo.join(first, "a").join(second, "b")), scratch)
    counts = found.where("y IS NULL").groupBy(F.col("x").alias("nid")).agg(F.sum("n").alias("linked"))
    comp = table(components(found.where("y IS NOT NULL").select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("node", "nid"), scratch)
    low = comp.join(per.select("nid", "least"), "nid").groupBy("component").agg(F.min("least").alias("low"))
    named = lookup(comp, low, "component").select("nid", "low", "component")
    answer = per.join(counts, "nid", "left").join(named, "nid", "left").select("key", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_similar"), F.coalesce("low", "least").alias("low"), F.coalesce("component", "nid").alias("group"))
    answer = table(answer)
    discard(spark, scratch)
    return rows, answer


def similar_sets(docs: DataFrame, rows_too: bool = False) -> DataFrame:
    """(doc_id, n_shingles, n_similar, component_id) for every row of ``docs`` (doc_id, text).

    A row's set: distinct runs of 5 words (ASCII white space between them, A-Z lower-cased); the whole
    sequence if there are fewer. Null, empty and blank texts have the empty set and no links. n_similar counts the other rows
    with Jaccard similarity of 0.8 at least, equal rows included; component_id is the smallest doc_id reached by links. A null
    doc_id counts as a row and is never the smallest unless all are null. With ``rows_too`` also digest (``text_digest``) and
    group, a number that exactly the rows joined by links share; null for an empty set.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with shuffles_removed(spark):
        rows, answer = _answers(docs)
    real = F.when(F.col("d") != _LEAST, F.col("d"))
    out = lookup(rows.select(real.alias("doc_id"), "key", "n", "digest"), answer, "key")
    return out.select(*(["digest", "group"] if rows_too else []), "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"), F.coalesce("low", "doc_id").alias("component_id"))
