"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are taken on the executors; the log-probability matrix (classes x HASH_SIZE, a fixed
number of columns) is broadcast and scoring is one sparse gather-and-sum per batch in numpy.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import bounded_batches, trim
from orrery.llm.textbytes import pieces

#: Columns of the count matrix.
HASH_SIZE = 1 << 16
#: Orders of the character n-grams.
ORDERS = (2, 3)
#: About so many labelled rows at most are used to fit; which ones depends on doc_id alone.
FIT_ROWS = 20_000
SMOOTHING = 0.1
UNKNOWN = "und"

_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """For each code point below 65536 its lower-case letter, or 32 where it is no letter."""
    if not _FOLD:
        t = np.full(1 << 16, 32, dtype=np.uint32)
        for c in range(1 << 16):
            if not 0xD800 <= c <= 0xDFFF and unicodedata.category(x := chr(c))[0] == "L":
                low = x.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _FOLD.append(t)
    return _FOLD[0]


def _letters(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(folded code points of all texts, offsets); runs of non-letters are one space, each text gets one more at its end."""
    cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    lead = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    at = lead[off]
    t = _fold()
    big = cp >= 1 << 16
    f = t[np.where(big, 32, cp)]
    for i in np.flatnonzero(big).tolist():
        if unicodedata.category(chr(cp[i]))[0] == "L":
            f[i] = cp[i]
    keep = np.ones(len(f), dtype=bool)
    keep[1:] = (f[1:] != 32) | (f[:-1] != 32)
    first = at[:-1][at[:-1] < at[1:]]
    keep[first] = True
    n = np.zeros(len(f) + 1, dtype=np.int64)
    np.cumsum(keep, out=n[1:])
    return f[keep], n[at]


def _features(f: np.ndarray, order: int) -> np.ndarray:
    """The hashed n-gram from each position that has one."""
    m = len(f) - order + 1
    if m <= 0:
        return np.zeros(0, dtype=np.int64)
    h = f[:m].astype(np.uint64)
    for i in range(1, order):
        h = h * np.uint64(0x9E3779B97F4A7C15) + f[i : m + i]
    h = (h + np.uint64(order)) * np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(48)).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


@dataclass
class LanguageModel:
    """``langs`` in order and their log-probabilities, HASH_SIZE x classes; ``prior`` per class."""

    langs: list[str]
    logp: np.ndarray
    prior: np.ndarray

    def scores(self, data: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language and its posterior for each text."""
        n, k = len(off) - 1, len(self.langs)
        f, at = _letters(data, off)
        has = np.zeros(len(f) + 1, dtype=np.int64)
        np.cumsum(f != 32, out=has[1:])
        letters = has[at[1:]] - has[at[:-1]]
        total = np.zeros((n, k))
        if k:
            total += self.prior
            for order in ORDERS:
                idx = _features(f, order)
                if not len(idx):
                    continue
                ends = np.maximum(at[1:] - order + 1, at[:-1])
                live = np.flatnonzero(ends > at[:-1])
                if not len(live):
                    continue
                cuts = np.stack([at[:-1][live], ends[live]], axis=1).ravel()
                if cuts[-1] == len(idx):
                    cuts = cuts[:-1]
                total[live] += np.add.reduceat(self.logp[idx], cuts, axis=0)[::2]
        best = total.argmax(axis=1) if k else np.zeros(n, dtype=int)
        top = np.exp(total - total.max(axis=1, keepdims=True)) if k else np.zeros((n, 1))
        post = np.where(letters > 0, 1 / top.sum(axis=1), 0.0) if k else np.zeros(n)
        return [self.langs[b] if k and x else UNKNOWN for b, x in zip(best.tolist(), letters.tolist())], post


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> LanguageModel:
    """Fits on texts with a non-null lang whose id isn't held out; about ``rows`` of them at most, picked by id."""
    spark = docs.sparkSession
    bounded_batches(spark)
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    n = train.select("lang").count()
    if n > rows:
        train = train.where(F.abs(F.xxhash64("doc_id") % 1_000_003) < int(1_000_003 * rows / n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[str, tuple[np.ndarray, int]] = {}
        for b in batches:
            langs = b.column(0).to_pylist()
            for i, j, data, off in pieces(b.column(1)):
                f, o = _letters(data, off)
                for order in ORDERS:
                    idx = _features(f, order)
                    for r in range(i, j):
                        c, m = at.get(langs[r], (None, 0))
                        if c is None:
                            c = np.zeros(HASH_SIZE, dtype=np.int64)
                        a, e = o[r - i], max(o[r - i], o[r - i + 1] - order + 1)
                        c += np.bincount(idx[a:e], minlength=HASH_SIZE)
                        at[langs[r]] = (c, m + (order == ORDERS[0]))
        if at:
            yield pa.record_batch([pa.array(list(at), pa.string()), pa.array([m for _, m in at.values()], pa.int64()), pa.array([c.tobytes() for c, _ in at.values()], pa.binary())], names=["lang", "n", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[str, list] = {}
        for b in batches:
            for lang, m, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                x = at.setdefault(lang, [0, np.zeros(HASH_SIZE, dtype=np.int64)])
                x[0] += m
                x[1] = x[1] + np.frombuffer(raw, dtype=np.int64)
        for lang, (m, c) in at.items():
            yield pa.record_batch([pa.array([lang], pa.string()), pa.array([m], pa.int64()), pa.array([c.tobytes()], pa.binary())], names=["lang", "n", "counts"])

    schema = "lang string, n long, counts binary"
    got = sorted(train.select("lang", "text").mapInArrow(count, schema).repartition("lang").mapInArrow(add, schema).collect(), key=lambda r: r.lang)
    langs = [r.lang for r in got]
    if not langs:
        return LanguageModel([], np.zeros((HASH_SIZE, 0), dtype=np.float32), np.zeros(0))
    c = np.stack([np.frombuffer(r.counts, dtype=np.int64) for r in got], axis=1) + SMOOTHING
    prior = np.array([r.n for r in got], dtype=float)
    return LanguageModel(langs, np.ascontiguousarray(np.log(c / c.sum(axis=0)), dtype=np.float32), np.log(prior / prior.sum()))


def identify(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """(*keep, lang_pred, score) for every row of ``docs``, read from its whole ``text``.

    keep: columns to hand through (default doc_id). A null text, one without a letter and any text
    under a model without classes get ``und`` and score 0. Ties go to the first language by name.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    keep = ["doc_id"] if keep is None else keep
    shared = spark.sparkContext.broadcast(model)
    at = keep.index("text") if "text" in keep else len(keep)  # a text that is kept goes to Python once
    source = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], *([docs["text"].alias("_t")] if at == len(keep) else []))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            langs: list[str] = []
            posts = [np.zeros(0)]
            for _, _, data, off in pieces(b.column(at), 1 << 19):
                x, p = m.scores(data, off)
                langs += x
                posts.append(p)
            yield pa.record_batch([*b.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(np.concatenate(posts), pa.float64())], names=[*(f"k{i}" for i in range(len(keep))), "lang_pred", "score"])
        trim()

    kinds = ", ".join(f"k{i} {source.schema[i].dataType.simpleString()}" for i in range(len(keep)))
    out = source.mapInArrow(score, f"{kinds}, lang_pred string, score double")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")
