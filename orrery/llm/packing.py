"""Sum-of-squares online packing of token sequences.

Each task packs the documents of its partition as they come. A document (or what is left after
full windows are cut from it) goes to the open window whose choice keeps the sum of squared
counts of open windows by fill level smallest; the counts stand in one array with an entry per
level. What is still open at the end of a partition is cut freely to fill windows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from orrery.llm.common import bounded_batches, trim
from orrery.llm.textbytes import IS_SPACE, LOWER, pieces, prefix_hash, span_hash, words

WINDOW = 4096
END_ID = 2
#: Whole words whose ids one worker keeps; beyond it the memory starts anew.
CACHE_WORDS = 400_000
#: Bytes of these words.
CACHE_BYTES = 16 << 20
_SLOTS = 1 << 20
_SHIFT = np.uint64(64 - 20)


class ByteLevelMerges:
    """Byte-pair merges of many words at once: words of one length are the rows of a matrix of symbol ids,
    and each step merges every row's lowest-ranked pair (the leftmost of equals)."""

    NONE = np.iinfo(np.int32).max
    LONGEST = 32

    def __init__(self, model: dict):
        vocab = model["vocab"]
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        odd = [b for b in range(256) if b not in set(printable)]
        chars = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(odd)}
        suffix = model.get("end_of_word_suffix") or ""
        self.first = np.array([vocab.get(chars[b], -1) for b in range(256)], dtype=np.int32)
        self.last = np.array([vocab.get(chars[b] + suffix, -1) for b in range(256)], dtype=np.int32)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        _, once = np.unique(keys, return_index=True)
        self.keys, self.rank, self.made = keys[once], once.astype(np.int32), made
        # a table of 2**21 slots answers nearly all lookups at once; the few keys that share a slot are searched
        self.slot = np.full(1 << 21, -1, dtype=np.int32)
        self.slot[self._slot(self.keys)] = np.arange(len(self.keys), dtype=np.int32)
        self.shared = np.flatnonzero(self.slot[self._slot(self.keys)] != np.arange(len(self.keys)))
        self.ok = bool((self.first >= 0).all() and (self.last >= 0).all()) and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges"))

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(43)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) * self.size + b
        at = self.slot[self._slot(keys)]
        out = np.where((at >= 0) & (self.keys[at] == keys), self.rank[at], self.NONE)
        if len(self.shared):
            some = self.keys[self.shared]
            j = np.minimum(np.searchsorted(some, keys), len(some) - 1)
            out = np.where(some[j] == keys, self.rank[self.shared[j]], out)
        return out.astype(np.int32)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids (unsigned 32-bit, as bytes) of each non-empty word, one pre-token each."""
        lens = np.array([len(w) for w in words])
        out: list[bytes] = [b""] * len(words)
        for n in np.unique(lens).tolist():
            who = np.flatnonzero(lens == n)
            raw = np.frombuffer(b"".join(words[i] for i in who.tolist()), dtype=np.uint8).reshape(len(who), n)
            s = self.first[raw]
            s[:, -1] = self.last[raw[:, -1]]
            r = self.ranks(s[:, :-1], s[:, 1:])
            while len(who):
                live = r.min(axis=1) < self.NONE if s.shape[1] > 1 else np.zeros(len(who), dtype=bool)
                stop = np.flatnonzero(~live)
                if len(stop):
                    width = 4 * s.shape[1]
                    buf = s[stop].astype("<u4").tobytes()
                    for k, i in enumerate(who[stop].tolist()):
                        out[i] = buf[k * width : (k + 1) * width]
                    who, s, r = who[live], s[live], r[live]
                    if not len(who):
                        break
                row = np.arange(len(who))
                at = r.argmin(axis=1)
                merged = self.made[r[row, at]]
                m = s.shape[1] - 1
                s = np.take_along_axis(s, np.arange(m) + (np.arange(m) > at[:, None]), axis=1)
                s[row, at] = merged
                if m > 1:
                    r = np.take_along_axis(r, np.arange(m - 1) + (np.arange(m - 1) >= at[:, None]), axis=1)
                    k = np.flatnonzero(at > 0)
                    r[k, at[k] - 1] = self.ranks(s[k, at[k] - 1], s[k, at[k]])
                    k = np.flatnonzero(at < m - 1)
                    r[k, at[k]] = self.ranks(s[k, at[k]], s[k, at[k] + 1])
                else:
                    r = r[:, :0]
        return out


#: ASCII punctuation but for the apostrophe, which begins some pre-tokens with letters.
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[*b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _apart(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks with the punctuation at their end as chunks of its own, where a Latin letter stands before it: there a pre-token ends."""
    if not len(starts):
        return starts, ends, first
    tail = ends.copy()
    live = np.flatnonzero(_PUNCT[data[ends - 1]])
    for _ in range(32):  # a longer run stays with its chunk
        if not len(live):
            break
        tail[live] -= 1
        live = live[tail[live] > starts[live]]
        live = live[_PUNCT[data[tail[live] - 1]]]
    tail[live] = starts[live]
    before, two = data[tail - 1], data[np.maximum(tail - 2, 0)]
    latin = _LETTER[before] | ((two == 0xC3) & (before >= 0x80) & (before < 0xC0) & (before != 0x97) & (before != 0xB7) & (tail - starts >= 2))
    special = (data[np.minimum(tail, len(data) - 1)] == 0x7C) & (data[np.minimum(tail + 1, len(data) - 1)] == 0x3E)  # |> ends an added token
    split = (tail > starts) & (tail < ends) & latin & ~special
    at = np.arange(len(starts)) + np.r_[0, np.cumsum(split)[:-1]]
    n = len(starts) + int(split.sum())
    s, e = np.empty(n, dtype=starts.dtype), np.empty(n, dtype=ends.dtype)
    s[at], e[at] = starts, np.where(split, tail, ends)
    s[at[split] + 1], e[at[split] + 1] = tail[split], ends[split]
    return s, e, np.r_[at, n][first]


class WordTokenizer:
    """Ids of texts by a word-level BPE file, each distinct white-space chunk encoded once
    and found again by its 64-bit hash.

    The file's pre-tokenizer never joins text across white space, so the ids of a text are those of
    its chunks in order. Chunks are cut at ASCII white space only. ASCII punctuation after a Latin letter
    is a chunk of its own. Chunks of Latin letters are merged here in bulk; all others go to the library.
    """

    #: Latin letters that NFC leaves alone and whose lower case is one letter.
    SIMPLE = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.merges = ByteLevelMerges(model)
        self.bulk = self.merges.ok and self._agrees()
        self._clear()

    def _agrees(self) -> bool:
        """Whether bulk merging and the library give the same for words of all kinds: other files are left to the library."""
        words = ["a", "the", "lowercase", "tokenization", "straße", "élève", "ÿ", "señor", "zzzzqqqq", "aaaaaaaa", "internationalisation"]
        got = self.merges.encode([w.encode() for w in words])
        same = all(np.frombuffer(g, dtype="<u4").tolist() == self.tokenizer.encode(w, add_special_tokens=False).ids for g, w in zip(got, words))
        return same and self.tokenizer.encode("The word,.. x", add_special_tokens=False).ids == [i for w in ("the", "word", ",..", "x") for i in self.tokenizer.encode(w, add_special_tokens=False).ids]

    def _clear(self) -> None:
        self.known = np.zeros(_SLOTS, dtype=np.uint64)  # word hashes by open addressing; 0: a free slot
        self.place = np.zeros(_SLOTS, dtype=np.int32)
        self.ids = np.zeros(1 << 20, dtype=np.uint32)
        self.ends = np.zeros(CACHE_WORDS + 1, dtype=np.int64)
        self.words = self.used = self.held = 0

    def _library(self, strings: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(strings, add_special_tokens=False)]

    def _encode(self, chunks: list[bytes]) -> list[bytes]:
        strings = [c.decode("utf-8") for c in chunks]
        if not self.bulk:
            return self._library(strings)
        longest, simple = ByteLevelMerges.LONGEST, self.SIMPLE.fullmatch
        easy = [i for i, s in enumerate(strings) if len(s) <= longest and simple(s)]
        out: list[bytes | None] = [None] * len(strings)
        for i, x in zip(easy, self.merges.encode([strings[i].lower().encode() for i in easy])):
            out[i] = x
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self._library([strings[i] for i in rest])):
            out[i] = x
        return out

    def _learn(self, hashes: np.ndarray, chunks: list[bytes]) -> None:
        """Keeps the ids of new chunks; ``hashes`` are theirs and distinct."""
        got = self._encode(chunks)
        flat = np.frombuffer(b"".join(got), dtype="<u4")
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        k = self.words
        self.ids[self.used : self.used + len(flat)] = flat
        self.ends[k + 1 : k + 1 + len(chunks)] = self.used + np.cumsum([len(g) // 4 for g in got])
        self.words, self.used, self.held = k + len(chunks), self.used + len(flat), self.held + sum(map(len, chunks))
        index = np.arange(k, k + len(chunks), dtype=np.int32)
        slot = (hashes >> _SHIFT).astype(np.int64)
        while len(hashes):
            free = np.flatnonzero(self.known[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.known[slot[won]], self.place[slot[won]] = hashes[won], index[won]
            left = np.ones(len(hashes), dtype=bool)
            left[won] = False
            hashes, index, slot = hashes[left], index[left], (slot[left] + 1) % _SLOTS

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The index of each hash, -1 where it is unknown."""
        out = np.full(len(h), -1, dtype=np.int32)
        slot = (h >> _SHIFT).astype(np.int64)
        who = None
        while True:
            there = self.known[slot]
            hit = there == h
            if who is None:
                out[hit] = self.place[slot[hit]]
                who = np.flatnonzero(~hit & (there != 0))
            else:
                out[who[hit]] = self.place[slot[hit]]
                who = who[~hit & (there != 0)]
            if not len(who):
                return out
            go = ~hit & (there != 0)
            slot, h = (slot[go] + 1) % _SLOTS, h[go]

    def encode(self, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of a piece (UTF-8 bytes and offsets)."""
        starts, ends, first = words(data, off, ~IS_SPACE)
        if self.bulk:
            starts, ends, first = _apart(data, starts, ends, first)
        if len(starts) > CACHE_WORDS // 2:  # in halves, so that the new words of a step always have room
            if len(off) > 2:
                m = len(off) // 2
                return self.encode(data[: off[m]], off[: m + 1]) + self.encode(data[off[m] :], off[m:] - off[m])
            cut = int(starts[len(starts) // 2])
            return [np.concatenate([self.encode(d, np.array([0, len(d)]))[0] for d in (data[:cut], data[cut:])])]
        data = LOWER[data]  # A to Z come out alike in either case
        h = span_hash(prefix_hash(data), starts, ends)
        h[h == 0] = 1
        at = self._find(h)
        if (at < 0).any():
            new, one = np.unique(h[at < 0], return_index=True)
            if self.words + len(new) > CACHE_WORDS or self.held > CACHE_BYTES:
                self._clear()
                at[:] = -1
                new, one = np.unique(h, return_index=True)
            k = np.flatnonzero(at < 0)[one]
            raw = data.tobytes()
            self._learn(new, [raw[a:b] for a, b in zip(starts[k].tolist(), ends[k].tolist())])
            at = self._find(h)
        a = self.ends[at]
        n = self.ends[at + 1] - a
        total = np.zeros(len(n) + 1, dtype=np.int64)
        np.cumsum(n, out=total[1:])
        ids = self.ids[np.repeat(a - total[:-1], n) + np.arange(total[-1])]
        cuts = total[first]
        return [ids[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> Callable[[np.ndarray, np.ndarray], list[np.ndarray]]:
    """The worker's tokenizer of that file."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path].encode


class SumOfSquares:
    """Windows of ``size`` filled online; ``place`` says into which window, and at which offset, a piece goes."""

    def __init__(self, size: int = WINDOW):
        self.size = size
        self.levels = np.zeros(size + 1, dtype=np.int64)
        self.open: dict[int, list[int]] = defaultdict(list)
        self.windows = 0

    def place(self, n: int) -> tuple[int, int]:
        """Window and offset for a piece of ``n`` (1 to size) tokens."""
        size, c = self.size, self.levels
        if n == size:
            self.windows += 1
            return self.windows - 1, 0
        # moving a window from level h to h + n changes the sum by 2 (c[h+n] - c[h]) + 2; closing one by 1 - 2 c[h]
        best, gain = 0, 2 * int(c[n]) + 1
        h = np.flatnonzero(c[1 : size - n]) + 1
        if len(h):
            d = 2 * (c[h + n] - c[h]) + 2
            i = len(d) - 1 - int(d[::-1].argmin())
            if d[i] <= gain:
                best, gain = int(h[i]), int(d[i])
        if c[size - n] and 1 - 2 * int(c[size - n]) <= gain:
            best = size - n
        if best:
            window = self.open[best].pop()
            c[best] -= 1
        else:
            window = self.windows
            self.windows += 1
        if best + n < size:
            c[best + n] += 1
            self.open[best + n].append(window)
        return window, best

    def unfilled(self) -> list[tuple[int, int]]:
        """(window, fill) of the windows that are still open."""
        return [(w, level) for level, ws in self.open.items() for w in ws]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, ids.

    Every document (null text: empty) is its ids and ``end_id``. A piece lies in one sequence;
    sequences hold at most ``window`` ids and their offsets have no gaps. sequence_id is unique but
    not gapless: its upper bits are the partition. Repeated rows are packed as often as they occur.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    id_type = pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal id_type
        encode = word_tokenizer(tokenizer_path)
        part = TaskContext.get().partitionId() << 33
        packer = SumOfSquares(window)
        waiting: dict[int, list[tuple]] = defaultdict(list)  # pieces of open windows
        fill: dict[int, int] = {}
        done: list[tuple] = []

        def rows() -> pa.RecordBatch:
            cols = list(zip(*done))
            arrays = [pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in (cols[1], [len(x) for x in cols[2]], [_crc(x) for x in cols[2]], cols[3], cols[4], cols[5]))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in cols[2]], pa.list_(pa.int32())))
                names.append("ids")
            done.clear()
            return pa.record_batch(arrays, names=names)

        def put(doc: object, start: int, ids: np.ndarray, total: int) -> None:
            w, at = packer.place(len(ids))
            piece = (doc, start, ids, total, part + w, at)
            if len(ids) == window:
                done.append(piece)
                return
            fill[w] = at + len(ids)
            waiting[w].append(piece)
            if fill[w] == window:
                done.extend(waiting.pop(w))
                fill.pop(w)

        end = np.array([end_id], dtype=np.uint32)
        for b in batches:
            id_type = b.schema.field(0).type
            docs_ids = b.column(0).to_pylist()
            for i, j, data, off in pieces(b.column(1)):
                for doc, ids in zip(docs_ids[i:j], encode(data, off)):
                    ids = np.concatenate([ids, end])
                    for s in range(0, len(ids), window):
                        put(doc, s, ids[s : s + window], len(ids))
            if len(done) > 2000:
                yield rows()
        # open windows are dissolved, fullest first kept whole while they are nearly full, and the rest cut to fit
        loose = [p for w, level in sorted(packer.unfilled()) if level < window - window // 64 for p in waiting.pop(w)]
        for ps in waiting.values():
            done.extend(ps)
        at = window
        for doc, start, ids, total, _, _ in loose:
            while len(ids):
                if at == window:
                    seq, at = part + packer.windows, 0
                    packer.windows += 1
                n = min(len(ids), window - at)
                done.append((doc, start, ids[:n], total, seq, at))
                start, ids, at = start + n, ids[n:], at + n
        if done:
            yield rows()
        trim()

    ids = ", ids array<int>" if with_ids else ""
    return source.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long{ids}")
