"""Removal of repeated byte windows by a depth-limited radix sort of suffixes.

Suffixes are ordered only through WIDTH bytes, by passes over ever longer digits, most significant first; a group of one
drops out of all later passes. The digits are content-defined, so that the passes need not start from
every byte:

1. Every window of WIDTH bytes has an *anchor*: the place of the smallest hash among its runs of DIGIT bytes.
   Equal windows have equal anchors. Consecutive windows share theirs, so one record per anchor (about one in 80 bytes)
   stands for a run of window starts. The first digit is the anchor's DIGIT bytes.
2. The second digit is all that the run's windows cover. Equal ones are repeated as a whole.
3. Where a first-digit group still holds several contents, one of each kind is opened into its windows, and whole windows are
   compared. Groups of two or more are exactly the repeated windows.

Equal texts are one text with a count from the start. Hot groups are counted map-side: a task sends one witness of a digit to its
group, however often it saw it.

The same passes run over words instead of bytes to find the *passages*: runs of more than PASSAGE - 1 words that stand in another
row, too. They are only counted, and both kinds of digits are drawn in one scan of the texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import BROADCAST_BYTES, Scatter, bounded_batches, bucketed, discard, likely, lookup, records, table, trim
from orrery.llm.textbytes import BASE, IS_ALNUM, buffers, mix, pieces, powers, prefix_hash, word_hashes

WIDTH = 400
#: Words of the shortest passage.
PASSAGE = 51
#: Bytes of a bucket of records that one task sorts.
BUCKET_BYTES = 8 << 20
_BLOCK = 1 << 21
_INDEX = np.uint64((1 << 24) - 1)

_FIRST = np.dtype([("h", "<u8"), ("key", "V16"), ("run", "<i4"), ("f", "u1")])
_LAST = np.dtype([("h", "<u8"), ("g", "<u4"), ("aid", "<i8"), ("o", "<i2"), ("f", "u1")])
_WORDS = np.dtype([("h", "<u8"), ("g", "<u4"), ("aid", "<i8"), ("o", "<i2"), ("doc", "<u8"), ("f", "u1")])
_COUNT = np.dtype([("key", "V16"), ("n", "<i8")])
#: What a record's f says: it asks; it is known to repeat and still a witness for others; it is known and no witness.
ASKS, KNOWN, PASSED = 0, 1, 2


@dataclass(frozen=True)
class Level:
    """Windows of ``width`` bytes, or of so many lower-cased words; the first digit is ``digit`` of them."""

    width: int
    digit: int
    words: bool = False

    @staticmethod
    def of(width: int, passage: int | None) -> tuple[Level, ...]:
        return (Level(width, width * 3 // 5), *((Level(passage, max(1, passage // 6), True),) if passage else ()))

    def units(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes, or hashes of the words, of texts, and where each text starts in them."""
        if not self.words:
            return data, off
        h, _, _, first = word_hashes(data, off, IS_ALNUM)
        return h, first

    def buckets(self, total: int) -> int:
        """Buckets for the anchors of ``total`` bytes of text."""
        found = 2 * (total // 5 if self.words else total) // (self.width - self.digit + 2) + 1
        return max(1, math.ceil(found * _FIRST.itemsize / BUCKET_BYTES))


def _sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of ``w`` entries the place of its smallest (leftmost of equals by the upper 40 bits)."""
    n = len(h)
    k = (h & ~_INDEX) | np.arange(n, dtype=np.uint64)
    rows = -(-n // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = k
    grid = padded.reshape(rows, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.ascontiguousarray(np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]).ravel()
    m = n - w + 1
    return (np.minimum(right[:m], left[w - 1 : w - 1 + m]) & _INDEX).astype(np.int64)


def runs(data: np.ndarray, off: np.ndarray, width: int = WIDTH, digit: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first start, last start, anchor hash) of the runs of windows that share an anchor; starts count from the text's first unit."""
    digit = digit or width * 3 // 5
    parts = []
    for at in range(0, max(1, len(data) - width + 1), _BLOCK):
        d = data[at : at + _BLOCK + width - 1]
        if len(d) < width:
            break
        p = prefix_hash(d)
        _, inv = powers(len(p))
        n = len(d) - digit + 1
        h = mix((p[digit:] - p[:n]) * inv[:n])
        a = _sliding_argmin(h, width - digit + 1)
        ends = np.clip(off[1:] - at, 0, None)
        lens = np.diff(np.clip(off - at, 0, len(d)))
        if len(off) == 2:
            j = np.arange(len(a))
            text = np.zeros(len(a), dtype=np.int64)
        else:
            text = np.repeat(np.arange(len(lens)), lens)[: len(a)]
            j = np.flatnonzero(ends[text] - np.arange(len(a)) >= width)
            text = text[j]
        if not len(j):
            continue
        aj = a[j]
        new = np.ones(len(j), dtype=bool)
        new[1:] = (aj[1:] != aj[:-1]) | (j[1:] != j[:-1] + 1)
        s = np.flatnonzero(new)
        e = np.r_[s[1:], len(j)] - 1
        base = off[text[s]]
        parts.append((text[s], j[s] + at - base, j[e] + at - base, h[aj[s]]))
    if not parts:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _count_map_side(r: np.ndarray, second: str | None, home: str, apart: str | None = None) -> np.ndarray:
    """Marks the records whose digit this task saw twice (in rows that differ in ``apart``); all but one of these leave for a bucket chosen by ``home``."""
    order = np.lexsort((r[second], r["h"])) if second else np.argsort(r["h"], kind="stable")
    r = r[order]
    new = np.ones(len(r), dtype=bool)
    new[1:] = r["h"][1:] != r["h"][:-1]
    if second:
        new[1:] |= r[second][1:] != r[second][:-1]
    at = np.flatnonzero(new)
    n = np.diff(np.r_[at, len(r)])
    again = n > 1
    if apart and len(at):
        again = np.minimum.reduceat(r[apart], at) != np.maximum.reduceat(r[apart], at)
    again = np.repeat(again, n)
    r["f"][again & new] = KNOWN
    r["f"][again & ~new] = PASSED
    rest = again & ~new
    where = r[home][rest]
    r["h"][rest] = mix(np.frombuffer(where.tobytes(), dtype=np.uint64).reshape(len(where), -1)[:, 0]) if len(where) else 0
    return r


def _repeated(r: np.ndarray, second: str | None, own: tuple[str, ...]) -> np.ndarray:
    """The records of a bucket that repeat: known ones, and those whose digit differs in place only."""
    known = r[r["f"] != ASKS]
    q = r[r["f"] != PASSED]
    if not len(q):
        return known
    order = np.lexsort((q[second], q["h"])) if second else np.argsort(q["h"], kind="stable")
    q = q[order]
    new = np.ones(len(q), dtype=bool)
    new[1:] = q["h"][1:] != q["h"][:-1]
    if second:
        new[1:] |= q[second][1:] != q[second][:-1]
    at = np.flatnonzero(new)
    n = np.diff(np.r_[at, len(q)])
    first = np.repeat(at, n)
    differs = np.zeros(len(q), dtype=bool)
    for name in own:
        differs |= q[name] != q[name][first]
    some = np.logical_or.reduceat(differs | (q["f"] == KNOWN), at)
    return np.concatenate([known, q[np.repeat(some, n) & (q["f"] == ASKS)]])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))).alias("d"), F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary"))).alias("key"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def _anchors(texts: DataFrame, levels: tuple[Level, ...], total: int) -> DataFrame:
    """First pass: (key, level, runs, n) of the runs whose anchor occurs elsewhere, too; at a level of words also rows without runs, n the words of a text."""
    first = np.cumsum([0, *(x.buckets(total) for x in levels)]).tolist()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outs = [Scatter(x.buckets(total), combine=lambda r: _count_map_side(r, None, "key")) for x in levels]
        seen: set[bytes] = set()

        def moved(k: int, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for p in parts:
                yield pa.record_batch([pa.array(p.column(0).to_numpy() + np.int32(first[k])), p.column(1)], schema=Scatter.ARROW)

        for b in batches:
            keys = b.column(0).to_pylist()
            live = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
            names = np.frombuffer(b"".join(keys[i] for i in live), dtype="V16")
            for i, j, data, off in pieces(b.column(1).take(pa.array(live))):
                for k, level in enumerate(levels):
                    units, at = level.units(data, off)
                    text, s, _, h = runs(units, at, level.width, level.digit)
                    r = np.zeros(len(text), dtype=_FIRST)
                    r["h"], r["key"] = h, names[i:j][text]
                    start = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else text
                    r["run"] = np.arange(len(text)) - np.repeat(start, np.diff(np.r_[start, len(text)]))
                    yield from moved(k, outs[k].add(r))
                    if level.words:
                        n = np.zeros(j - i, dtype=_COUNT)
                        n["key"], n["n"] = names[i:j], np.diff(at)
                        n = n[n["n"] >= level.width]
                        if len(n):
                            yield pa.record_batch([pa.array([-1 - int.from_bytes(keys[live[i]][:4]) % first[-1]], pa.int32()), pa.array([n.tobytes()], pa.binary())], schema=Scatter.ARROW)
        for k, out in enumerate(outs):
            yield from moved(k, out.out())

    def judge(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        if bucket < 0:
            n = np.unique(records(t.column("payload"), _COUNT).view("S24")).view(_COUNT)
            return pa.table({"key": pa.array([x.tobytes() for x in n["key"]], pa.binary()), "level": pa.array([len(levels) - 1] * len(n), pa.int32()), "runs": pa.array([None] * len(n), pa.binary()), "n": pa.array(n["n"], pa.int64())})
        r = _repeated(records(t.column("payload"), _FIRST), None, ("key", "run"))
        order = np.argsort(np.frombuffer(r["key"].tobytes(), dtype="S16"), kind="stable") if len(r) else np.zeros(0, dtype=np.int64)
        r = r[order]
        cut = np.flatnonzero(np.r_[True, r["key"][1:] != r["key"][:-1], True]) if len(r) else np.zeros(1, dtype=np.int64)
        keys = [r["key"][i].tobytes() for i in cut[:-1]]
        vals = [np.unique(r["run"][i:j]).astype("<i4").tobytes() for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]
        return pa.table({"key": pa.array(keys, pa.binary()), "level": pa.array([int(np.searchsorted(first, bucket, side="right")) - 1] * len(keys), pa.int32()), "runs": pa.array(vals, pa.binary()), "n": pa.array([None] * len(keys), pa.int64())})

    sent = texts.where(F.octet_length("text") >= min(x.width for x in levels)).select("key", "text").mapInArrow(send, Scatter.SCHEMA)
    return sent.groupBy("bucket").applyInArrow(judge, "key binary, level int, runs binary, n long")


def _of_texts(work: DataFrame, lists: DataFrame, name: str) -> DataFrame:
    """``work`` (key unique) with its entry of ``lists``; the lists are broadcast where their measured size allows it."""
    small = lists.agg(F.coalesce(F.sum(F.col("bytes") + 64), F.lit(0))).first()[0] <= BROADCAST_BYTES
    lists = lists.select("key", name)
    return work.join(F.broadcast(lists) if small else lists, "key")


def _contents(work: DataFrame, levels: tuple[Level, ...]) -> DataFrame:
    """(level, key, n, digit, content, s, e) of the surviving runs: n copies of the text, the second digit's hash, first and last start."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, many = (b.column(i).to_pylist() for i in (0, 1))
            marks = [b.column(3 + k).to_pylist() for k in range(len(levels))]
            for i, j, data, off in pieces(b.column(2)):
                for k, level in enumerate(levels):
                    if not any(marks[k][i:j]):
                        continue
                    units, at = level.units(data, off)
                    text, s, e, h = runs(units, at, level.width, level.digit)
                    first = np.searchsorted(text, np.arange(j - i + 1))
                    raw, size = units.tobytes(), units.itemsize
                    cols: list[list] = [[], [], [], [], [], [], []]
                    for r in range(i, j):
                        if not marks[k][r]:
                            continue
                        own = first[r - i] + np.unique(np.concatenate([np.frombuffer(x, dtype="<i4") for x in marks[k][r]]))
                        o = int(at[r - i])
                        ss, ee = s[own].tolist(), e[own].tolist()
                        cols[0] += [k] * len(ss)
                        cols[1] += [keys[r]] * len(ss)
                        cols[2] += [many[r]] * len(ss)
                        cols[3] += h[own].view(np.int64).tolist()
                        cols[4] += [xxhash.xxh3_128_digest(raw[(o + x) * size : (o + y + level.width) * size]) for x, y in zip(ss, ee)]
                        cols[5] += ss
                        cols[6] += ee
                    kinds = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32())
                    yield pa.record_batch([pa.array(c, x) for c, x in zip(cols, kinds)], names=["level", "key", "n", "digit", "content", "s", "e"])
        trim()

    return work.select("key", "n", "text", *(f"runs{k}" for k in range(len(levels)))).mapInArrow(scan, "level int, key binary, n long, digit long, content binary, s int, e int")


_BASE2 = (BASE * 0xD1342543DE82EF95 + 2) % (1 << 64) | 1


def _second_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.full(len(data) + 1, np.uint64(_BASE2), dtype=np.uint64)
    p[0] = 1
    pw = np.multiply.accumulate(p)
    q = np.full(len(data) + 1, np.uint64(pow(_BASE2, -1, 1 << 64)), dtype=np.uint64)
    q[0] = 1
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pw[:-1], out=out[1:])
    return out, np.multiply.accumulate(q)


def _windows(opened: DataFrame, buckets: int, level: Level) -> DataFrame:
    """Third pass: (aid, offsets) of the opened runs' windows that occur elsewhere, too; in another text, for words."""
    kind = _WORDS if level.words else _LAST

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, width = Scatter(buckets, combine=lambda r: _count_map_side(r, "g", "aid", "doc" if level.words else None)), level.width
        for b in batches:
            lists, keys = b.column(1).to_pylist(), b.column(2).to_pylist()
            data, off = level.units(*buffers(b.column(0)))
            for i, spans in enumerate(lists):
                d = data[off[i] : off[i + 1]]
                for x in sorted(spans, key=lambda x: x["s"]):
                    own = d[x["s"] : x["e"] + width]
                    n = x["e"] - x["s"] + 1
                    p = prefix_hash(own)
                    _, inv = powers(len(p))
                    p2, inv2 = _second_hash(own)
                    r = np.zeros(n, dtype=kind)
                    r["h"] = mix((p[width:] - p[:n]) * inv[:n])
                    r["g"] = mix((p2[width:] - p2[:n]) * inv2[:n]) >> np.uint64(32)
                    r["aid"], r["o"] = x["aid"], np.arange(n)
                    if level.words:  # a run that other texts hold as a whole is a witness against all
                        r["doc"], r["f"] = np.frombuffer(keys[i], dtype="<u8")[0], KNOWN if x["shared"] else ASKS
                    yield from out.add(r)
        yield from out.out()

    def judge(t: pa.Table) -> pa.Table:
        r = _repeated(records(t.column("payload"), kind), "g", ("doc",) if level.words else ("aid", "o"))
        r = r[np.lexsort((r["o"], r["aid"]))]
        cut = np.flatnonzero(np.r_[True, r["aid"][1:] != r["aid"][:-1], True]) if len(r) else np.zeros(1, dtype=np.int64)
        offs = [r["o"][i:j].astype("<i2").tobytes() for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]
        return pa.table({"aid": pa.array(r["aid"][cut[:-1]], pa.int64()), "offs": pa.array(offs, pa.binary())})

    return opened.select("text", "spans", "key").mapInArrow(send, Scatter.SCHEMA).groupBy("bucket").applyInArrow(judge, "aid long, offs binary")


def _covered(spans: list[dict], width: int, size: int) -> np.ndarray:
    """Which of ``size`` units the windows that start in the spans cover."""
    edge = np.zeros(size + 1, dtype=np.int32)
    for x in spans:
        if x["offs"] is None:
            edge[x["s"]] += 1
            edge[x["e"] + width] -= 1
        else:
            at = x["s"] + np.frombuffer(x["offs"], dtype="<i2").astype(np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + width, -1)
    return np.cumsum(edge[:-1]) > 0


def _counted(gone: DataFrame, width: int) -> DataFrame:
    """(key, n_shared) of the texts with their repeated starts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [int(_covered(x, width, max(y["e"] for y in x) + width).sum()) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64())], names=["key", "n_shared"])

    return gone.select("key", "spans").mapInArrow(count, "key binary, n_shared long")


def _remove(marked: DataFrame, width: int, with_text: bool) -> DataFrame:
    """(key, n_removed, n_spans, kept_sha256, kept) of the texts with their repeated starts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, text, spans in zip(*(b.column(i).to_pylist() for i in range(3))):
                raw = text.encode()
                gone = _covered(spans, width, len(raw))
                kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
                starts = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((key, int(gone.sum()), starts, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], names=["key", "n_removed", "n_spans", "kept_sha256", "kept"])

    return marked.select("key", "text", "spans").mapInArrow(cut, "key binary, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _repeats(occ: DataFrame, kinds: DataFrame, work: DataFrame, level: Level, scratch: list[str]) -> DataFrame:
    """Second and third pass at one level: (key, spans, bytes), spans the repeated starts of a text."""
    several = kinds.groupBy("digit").agg(F.count("*").alias("c")).where("c > 1").select("digit")
    opened = table(lookup(kinds.select("digit", "one", "shared", "content"), several, "digit", "inner").select("one.*", "shared", "content"), scratch).withColumn("aid", F.monotonically_increasing_id())
    opened = table(opened, scratch)
    spans = opened.groupBy("key").agg(F.collect_list(F.struct("s", "e", "aid", "shared")).alias("spans"), (F.count("*") * 24).alias("bytes"))
    n_windows = opened.agg(F.coalesce(F.sum(F.col("e") - F.col("s") + 1), F.lit(0))).first()[0]
    size = (_WORDS if level.words else _LAST).itemsize
    hits = table(_windows(_of_texts(work.select("key", "text"), table(spans, scratch), "spans"), max(1, math.ceil(n_windows * size / BUCKET_BYTES)), level), scratch)
    whole = lookup(occ.select("key", "s", "e", "content"), kinds.where("shared").select("content"), "content", "inner").select("key", "s", "e", F.lit(None).cast("binary").alias("offs"))
    part = hits.join(opened, "aid")
    if level.words:  # a run may stand several times in its one text
        part = lookup(occ.select("key", "s", "e", "content"), table(part.where("NOT shared").select("content", "offs"), scratch), "content", "inner")
    part = part.select("key", "s", "e", "offs")
    return table(whole.unionByName(part).groupBy("key").agg(F.collect_list(F.struct("s", "e", "offs")).alias("spans"), F.sum(F.coalesce(F.octet_length("offs"), F.lit(0)) + 16).alias("bytes")), scratch)


def repeated_spans(docs: DataFrame, width: int = WIDTH, with_text: bool = False, passage: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept][, n_shared_words]) for every row of ``docs`` (doc_id, text).

    Removed is each byte covered by a string of ``width`` bytes that also starts anywhere else, in
    the same or another row. A null text is empty; an empty text removes nothing; repeated rows are copies of each other, so
    texts of ``width`` bytes or more in them are removed whole. Matches never cross rows. An
    empty table gives an empty result. ``with_text`` adds the kept bytes of rows that lost some (else null); ``passage`` the number of
    words in runs of at least so many words (lower-cased runs of letters, digits and non-ASCII signs) that stand in another row, too.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    levels = Level.of(width, passage)
    texts = _texts(docs)
    base = table(docs.select("doc_id", F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary"))).alias("key"), F.coalesce(F.octet_length(docs["text"]), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256).alias("all_sha256")))
    per = base.groupBy("key").agg(F.count("*").alias("n"), F.min(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).alias("d"))
    total = base.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    scratch: list[str] = []
    first = table(_anchors(texts, levels, total), scratch)
    marks = [F.collect_list(F.when(F.col("level") == k, F.col("runs"))).alias(f"runs{k}") for k in range(len(levels))]
    lists = table(first.where("runs IS NOT NULL").groupBy("key").agg(*marks).join(per, "key"), scratch)
    # one row of each text that shares a digit moves, once
    row = lambda: F.unhex(F.md5(F.concat("key", F.col("d").cast("string").cast("binary"))))
    some = texts.where(likely(lists.select(row().alias("row")))(row())).select("key", "text").dropDuplicates(["key"])
    work = bucketed(some.join(lists.hint("shuffle_merge"), "key").select("key", "n", "text", *(f"runs{k}" for k in range(len(levels)))), "key", total, scratch)

    found = table(_contents(work, levels), scratch, "level")
    occ = [found.where(F.col("level") == k) for k in range(len(levels))]
    elsewhere = (F.min("key") != F.max("key")) | (F.max("n") > 1)
    kinds = [table(x.groupBy("content").agg((elsewhere if k else F.sum("n") > 1).alias("shared"), F.min_by(F.struct("key", "s", "e"), F.struct("key", "s")).alias("one"), F.first("digit").alias("digit")), scratch) for k, x in enumerate(occ)]
    gone = [_repeats(*x, work, level, scratch) for *x, level in zip(occ, kinds, levels)]
    result = table(_remove(_of_texts(work.select("key", "text"), gone[0], "spans"), width, with_text), scratch)

    copies = per.where("n > 1").select("key", F.lit(True).alias("copied"))
    if passage:
        words = first.where("runs IS NULL").groupBy("key").agg(F.max("n").alias("n_shared"))
        copied = words.join(copies, "key", "left_semi")
        part = table(_counted(gone[1], passage), scratch).join(copies, "key", "left_anti")
        result = result.join(copied.unionByName(part), "key", "full")
    result = table(copies.join(result, "key", "full"))
    discard(spark, scratch)
    out = lookup(base, result, "key")
    all_gone = F.col("copied") & (F.col("n_bytes") >= width)
    empty = hashlib.sha256(b"").hexdigest()
    columns = [
        "doc_id",
        "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(all_gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
    ]
    if with_text:
        columns.append(F.when(all_gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
    if passage:
        columns.append(F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared_words"))
    return out.select(*columns)
