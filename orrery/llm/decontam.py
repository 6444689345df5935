"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items.

The symbols are words: each 13-word window of an item is a pattern, and the automaton (goto, failure and output links) is a
handful of arrays, about 40 times the benchmark's bytes. A text is normalised and read once. Words that follow each other
in no item take the automaton back to its root, so only stretches of words that all do (found by a bitmap of word pairs)
are run through it, many of them in step. What occurs is mapped back to words and code points of the original text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import bounded_batches, trim
from orrery.llm.textbytes import IS_ALNUM, MULS, buffers, mix, pieces, word_hashes

WINDOW = 13
#: Most bytes of normalised benchmark text in one automaton (160 MB then). More text makes more of them; texts are still read
#: once, and only the stretches that could match meet all of them.
AUTOMATON_BYTES = 4 << 20
#: Words of a stretch that one lane runs through.
LANE = 256
#: Bits of the pair bitmap: at least so many for each pair of words, at most 2**31.
PAIR_BITS = 32


def _pairs(h: np.ndarray, bits: int) -> np.ndarray:
    """A bit number for each two words that follow each other."""
    return mix(h[:-1] * MULS[0] + h[1:] * MULS[1]) >> np.uint64(64 - bits)


def item_words(text: str | None) -> np.ndarray:
    """The hashes of a text's words; null has none."""
    return word_hashes(*buffers(pa.array([text or ""])), IS_ALNUM)[0]


class PairMap:
    """Which words follow each other in some item, as a bitmap (others may be marked, too), and the words of one-word items."""

    def __init__(self, n_pairs: int):
        self.bits = min(31, max(16, math.ceil(math.log2(max(1, n_pairs * PAIR_BITS)))))
        self.map = np.zeros(1 << (self.bits - 3), dtype=np.uint8)
        self.least = WINDOW
        self.one: set[int] = set()

    def add(self, h: np.ndarray) -> None:
        if len(h) == 1:
            self.one.add(int(h[0]))
        elif len(h):
            self.least = min(self.least, len(h))
            k = _pairs(h, self.bits)
            np.bitwise_or.at(self.map, (k >> np.uint64(3)).astype(np.int64), np.uint8(1) << (k & np.uint64(7)).astype(np.uint8))

    def stretches(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the stretches of words of one text that hold all occurrences of items."""
        v = np.zeros(len(h) + 1, dtype=bool)
        if len(h) > 1:
            k = _pairs(h, self.bits)
            v[1:-1] = (self.map[(k >> np.uint64(3)).astype(np.int64)] >> (k & np.uint64(7)).astype(np.uint8)) & 1
            v[first[:-1]] = False
        edge = np.diff(v.astype(np.int8), prepend=0)
        s, e = np.flatnonzero(edge == 1) - 1, np.flatnonzero(edge == -1)
        long = e - s >= self.least
        s, e = s[long], e[long]
        if self.one:
            at = np.flatnonzero(np.isin(h, np.array(sorted(self.one), dtype=np.uint64)))
            k = np.searchsorted(s, at, side="right") - 1
            free = at[(k < 0) | (at >= e[k])] if len(s) else at
            s, e = np.r_[s, free], np.r_[e, free + 1]
        return s, e


class Automaton:
    """Aho-Corasick over sequences of word hashes. Node 0 is the root; node k + 1 is reached by edge k, edges are ordered by (node, word)."""

    def __init__(self, items: list[tuple[str, np.ndarray]]):
        self.names = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.names)}
        items = [(number[i], h) for i, h in items if len(h)]
        self.vocabulary = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, dtype=np.uint64)
        self.v = len(self.vocabulary) + 1
        rows, owner = [np.zeros((0, WINDOW), dtype=np.int32)], [np.zeros(0, dtype=np.int32)]
        for i, h in items:
            x = np.searchsorted(self.vocabulary, h).astype(np.int32)
            rows.append(np.lib.stride_tricks.sliding_window_view(x, WINDOW) if len(x) >= WINDOW else np.r_[x, np.full(WINDOW - len(x), -1, dtype=np.int32)][None, :])
            owner.append(np.full(len(rows[-1]), i, dtype=np.int32))
        rows, owner = np.concatenate(rows), np.concatenate(owner)
        at, n = np.zeros(len(rows), dtype=np.int64), 1
        keys, parents, depth = [], [np.zeros(1, dtype=np.int64)], [np.zeros(1, dtype=np.int8)]
        for d in range(WINDOW):
            live = rows[:, d] >= 0
            key, inv = np.unique(at[live] * self.v + rows[live, d], return_inverse=True)
            keys.append(key)
            parents.append(key // self.v)
            depth.append(np.full(len(key), d + 1, dtype=np.int8))
            at[live] = n + inv
            n += len(key)
        self.keys, parent, self.depth = np.concatenate(keys), np.concatenate(parents), np.concatenate(depth)
        self.fail, self.link = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
        ends, first = np.unique(np.stack([at, owner], axis=1), axis=0).T if len(at) else (at, owner)
        nodes, start = np.unique(ends, return_index=True)
        self.owner, self.start = first.astype(np.int32), np.r_[start, len(ends)].astype(np.int64)
        self.end = np.zeros(n, dtype=np.int32)  # one more than the place in start
        self.end[nodes] = np.arange(1, len(nodes) + 1)
        low = 1
        for key in keys:  # by depth: failure links lead to nodes that have theirs
            own = np.arange(low, low + len(key))
            if low > 1 and len(key):
                self.fail[own] = self.step(self.fail[parent[own]].astype(np.int64), key % self.v)
            f = self.fail[own]
            self.link[own] = np.where(self.end[f] > 0, f, self.link[f])
            low += len(key)

    def step(self, node: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Where the words lead from the nodes; a word of no item (-1) to the root."""
        out = np.zeros(len(node), dtype=np.int64)
        todo = np.flatnonzero(word >= 0)
        while len(todo):
            key = node[todo] * self.v + word[todo]
            k = np.searchsorted(self.keys, key)
            ok = self.keys[np.minimum(k, len(self.keys) - 1)] == key
            out[todo[ok]] = k[ok] + 1
            todo = todo[~ok & (node[todo] > 0)]
            node[todo] = self.fail[node[todo]]
        return out

    def match(self, h: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, end, place in start) of every pattern inside the stretches s..e of the words ``h``."""
        none = np.zeros(0, dtype=np.int64)
        if not len(s) or not len(self.vocabulary):
            return none, none, none
        n = -(-(e - s) // LANE)
        own = np.repeat(np.arange(len(s)), n)
        real = s[own] + LANE * (np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n))
        lead, last = np.maximum(s[own], real - WINDOW + 1), np.minimum(e[own], real + LANE)
        order = np.argsort(lead - last, kind="stable")
        real, lead, last = real[order], lead[order], last[order]
        size = last - lead
        state, places, nodes = np.zeros(len(lead), dtype=np.int64), [], []
        for t in range(int(size[0])):
            k = int(np.searchsorted(-size, -t, side="left"))
            at = lead[:k] + t
            x = np.searchsorted(self.vocabulary, h[at])
            word = np.where(self.vocabulary[np.minimum(x, len(self.vocabulary) - 1)] == h[at], x, -1)
            state[:k] = self.step(state[:k].copy(), word)
            hit = np.flatnonzero(((self.end[state[:k]] > 0) | (self.link[state[:k]] > 0)) & (at >= real[:k]))
            places.append(at[hit])
            nodes.append(state[hit])
        at, node = np.concatenate(places), np.concatenate(nodes)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(node):
            ok = self.end[node] > 0
            out.append((at[ok] + 1 - self.depth[node[ok]], at[ok] + 1, self.end[node[ok]].astype(np.int64) - 1))
            at, node = at[self.link[node] > 0], self.link[node][self.link[node] > 0]
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (none, none, none)

    def items(self, place: np.ndarray) -> set[str]:
        """Names of the items that have a pattern of these places."""
        return {self.names[i] for p in np.unique(place) for i in self.owner[self.start[p] : self.start[p + 1]]}


class Bench:
    """The benchmark, broadcast in parts of bounded size: the pairs of all items, and automata over the items in turn."""

    def __init__(self, benchmark: DataFrame, limit: int = AUTOMATON_BYTES):
        context = benchmark.sparkSession.sparkContext
        items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
        size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        pairs = PairMap(size // 5)
        n = max(1, math.ceil(size / limit))
        self.automata = []
        for g in range(n):
            own = [(r.item, item_words(r.text)) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == g).toLocalIterator()]
            for _, h in own:
                pairs.add(h)
            self.automata.append(context.broadcast(Automaton(own)))
        self.pairs = context.broadcast(pairs)


def _merged(first: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Runs of words that the spans cover together."""
    out: list[list[int]] = []
    for s, e in sorted(set(zip(first.tolist(), end.tolist()))):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _by_text(n: int, owner: np.ndarray, spans: tuple[np.ndarray, np.ndarray, np.ndarray], a: Automaton) -> Iterator[tuple[int, np.ndarray, np.ndarray, set[str]]]:
    """(text, firsts, ends, items) of the texts that have any."""
    order = np.argsort(owner, kind="stable")
    cut = np.searchsorted(owner[order], np.arange(n + 1))
    for t in np.unique(owner).tolist():
        k = order[cut[t] : cut[t + 1]]
        yield t, spans[0][k], spans[1][k], a.items(spans[2][k])


_RUN = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
_REST = pa.list_(pa.struct([("at", pa.int32()), ("w", pa.binary())]))
_ADDED = "hits array<struct<first:int,end:int>>, items array<string>"


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, limit: int = AUTOMATON_BYTES) -> DataFrame:
    """(*keep, n_words, n_hit, items, hits) for every row of ``docs``.

    docs: text and the columns ``keep`` (default doc_id). benchmark: item_id, text; rows with a
    null in either are skipped, equal windows of several items count for each, an id that
    repeats counts once. hits: the word positions inside an occurrence, as (first, end) runs. A null or empty text has
    no words and no hits.
    """
    keep = ["doc_id"] if keep is None else keep
    found = _found(docs, Bench(benchmark, limit), keep)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_words", "n_hit", "items", "hits")


def _found(docs: DataFrame, bench: Bench, keep: list[str]) -> DataFrame:
    """``scan`` with the columns ``keep`` as k0, k1 and so on."""
    bounded_batches(docs.sparkSession)
    names = [f"k{i}" for i in range(len(keep))]
    at = keep.index("text") if "text" in keep else len(keep)
    source = docs.select(*[docs[c].alias(n) for c, n in zip(keep, names)], *([docs["text"].alias("_t")] if at == len(keep) else []))
    base = ", ".join(f"{n} {source.schema[n].dataType.simpleString()}" for n in names)
    shared, first_one, more = bench.pairs, bench.automata[0], bench.automata[1:]
    k, several = len(keep), bool(bench.automata[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, a = shared.value, first_one.value
        for b in batches:
            n_words, hits, items, rest = [], [[] for _ in range(b.num_rows)], [[] for _ in range(b.num_rows)], [[] for _ in range(b.num_rows)]
            for i, j, data, off in pieces(b.column(at)):
                h, _, _, first = word_hashes(data, off, IS_ALNUM)
                n_words += np.diff(first).tolist()
                s, e = pairs.stretches(h, first)
                spans = a.match(h, s, e)
                for t, x, y, found in _by_text(j - i, np.searchsorted(first, spans[0], side="right") - 1, spans, a):
                    hits[i + t] = [{"first": p, "end": q} for p, q in _merged(x - first[t], y - first[t])]
                    items[i + t] = sorted(found)
                if several:
                    for p, q, t in zip(s.tolist(), e.tolist(), (np.searchsorted(first, s, side="right") - 1).tolist()):
                        rest[i + t].append({"at": p - int(first[t]), "w": h[p:q].tobytes()})
            cols = [pa.array(n_words, pa.int64()), pa.array(hits, _RUN), pa.array(items, pa.list_(pa.string()))]
            yield pa.record_batch([*b.columns[:k], *cols, *([pa.array(rest, _REST)] if several else [])], names=[*names, "n_words", "hits", "items", *(["rest"] if several else [])])
        trim()

    out = source.mapInArrow(run, f"{base}{', ' if base else ''}n_words long, {_ADDED}{', rest array<struct<at:int,w:binary>>' if several else ''}")
    for held in more:
        out = _again(out, held)
    return out.select(*names, "n_words", F.coalesce(F.expr("aggregate(hits, 0L, (a, x) -> a + x.end - x.first)"), F.lit(0)).alias("n_hit"), "items", "hits")


def _again(out: DataFrame, held: object) -> DataFrame:
    """``out`` with the hits of one more automaton in the stretches of its column rest."""
    place = {n: i for i, n in enumerate(out.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = held.value
        for b in batches:
            hits, items, rest = (b.column(place[n]).to_pylist() for n in ("hits", "items", "rest"))
            flat = [(r, x["at"], np.frombuffer(x["w"], dtype=np.uint64)) for r, xs in enumerate(rest) for x in xs]
            if flat:
                cut = np.cumsum([0, *(len(w) for _, _, w in flat)])
                spans = a.match(np.concatenate([w for _, _, w in flat]), cut[:-1], cut[1:])
                of = np.searchsorted(cut, spans[0], side="right") - 1
                back = np.array([at for _, at, _ in flat]) - cut[:-1]
                spans = (spans[0] + back[of], spans[1] + back[of], spans[2])
                for r, x, y, found in _by_text(b.num_rows, np.array([r for r, _, _ in flat])[of], spans, a):
                    x, y = np.r_[x, [z["first"] for z in hits[r]]].astype(np.int64), np.r_[y, [z["end"] for z in hits[r]]].astype(np.int64)
                    hits[r] = [{"first": p, "end": q} for p, q in _merged(x, y)]
                    items[r] = sorted(found.union(items[r]))
            cols = list(b.columns)
            cols[place["hits"]], cols[place["items"]] = pa.array(hits, _RUN), pa.array(items, pa.list_(pa.string()))
            yield pa.record_batch(cols, names=b.schema.names)
        trim()

    return out.mapInArrow(run, out.schema)


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words") -> Column:
    """At least one hit, and hits are 1 in 20 words or more."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def offsets(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, end) in code points of the runs (first, end) of words, ends exclusive."""
    data, off = buffers(pa.array([text]))
    _, starts, ends, _ = word_hashes(data, off, IS_ALNUM)
    point = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    return [(int(point[starts[s]]), int(point[ends[e - 1]])) for s, e in runs]


def without(text: str, runs: list[tuple[int, int]]) -> str:
    """``text`` without the runs (first, end) of words and the signs between them and the next word."""
    spans, at, out = offsets(text, runs), 0, []
    after = offsets(text, [(e, e + 1) for _, e in runs if e < len(item_words(text))])
    for i, (s, e) in enumerate(spans):
        out.append(text[at:s])
        at = after[i][0] if i < len(after) else e
    return "".join(out) + text[at:]


def clean(docs: DataFrame, benchmark: DataFrame, limit: int = AUTOMATON_BYTES) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, benchmark passages cut out of their texts.

    A text from which something was cut holds no window of the benchmark any more, not even across a cut, and n_chars (if there is such a column) is
    counted anew; all other rows stay as they are, those with null texts included.
    """
    bench, names = Bench(benchmark, limit), docs.columns
    shared, held = bench.pairs, bench.automata

    @F.pandas_udf("string")
    def cut(text, hits):  # noqa: ANN001, ANN202
        def one(t: str | None, runs: object) -> str | None:
            if t is None or runs is None:
                return t
            spans = [(x["first"], x["end"]) for x in runs]
            while spans:
                t = without(t, spans)
                h = item_words(t)
                s, e = shared.value.stretches(h, np.array([0, len(h)]))
                got = [a.value.match(h, s, e) for a in held]
                spans = _merged(np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got]))
            return t

        return text.combine(hits, one)

    hit = F.col("n_hit") > 0
    text = f"k{names.index('text')}"
    found = _found(docs, bench, names).where(~contaminated())
    found = found.withColumn("new", cut(F.when(hit, F.col(text)), F.when(hit, F.col("hits"))))  # only texts with hits go to Python
    columns = {c: F.col(f"k{i}") for i, c in enumerate(names)}
    columns["text"] = F.when(hit, F.col("new")).otherwise(F.col(text))
    if "n_chars" in names:
        columns["n_chars"] = F.when(hit, F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return found.select(*[x.alias(c) for c, x in columns.items()])


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
