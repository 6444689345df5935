"""Vectorised work on the UTF-8 bytes of an Arrow string column.

A batch of texts is one byte buffer plus offsets; tokenising, hashing and scanning
run as numpy passes over that buffer, never as a Python loop over characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Odd base of the polynomial hash modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
_MULS = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25, 0xC4CEB9FE1A85EC53]
MULS = [_U(m | 1) for m in _MULS]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: ASCII white space: 0x20 and 0x09-0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Word bytes of the alphanumeric tokeniser: 0-9, a-z (after lower-casing) and all of >= 0x80.
IS_ALNUM = np.zeros(256, dtype=bool)
IS_ALNUM[0x30:0x3A] = True
IS_ALNUM[0x61:0x7B] = True
IS_ALNUM[0x41:0x5B] = True
IS_ALNUM[0x80:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_POW = [np.ones(1, dtype=_U), np.ones(1, dtype=_U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n, kept between calls."""
    if len(_POW[0]) < n:
        m = max(n, 1 << 16)
        for k, b in enumerate((BASE, BASE_INV)):
            p = np.full(m, _U(b), dtype=_U)
            p[0] = 1
            _POW[k] = np.multiply.accumulate(p)
    return _POW[0][:n], _POW[1][:n]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty texts."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = col.buffers()[2] if len(col) else None
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(col: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive runs of whole texts of about ``most`` bytes.

    A text longer than that is a run of its own; texts are never cut.
    """
    data, off = buffers(col)
    n, i = len(off) - 1, 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1))
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each text) of the maximal runs of bytes for which ``inside`` (per byte value) holds."""
    w = inside[data]
    n = len(w)
    s = w.copy()
    s[1:] &= ~w[:-1]
    e = w.copy()
    e[:-1] &= ~w[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    s[edge] = w[edge]
    e[edge - 1] = w[edge - 1]
    starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
    return starts, ends, np.searchsorted(starts, off)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of (byte + 1) * BASE**k over i <= k < j, modulo 2**64."""
    pw, _ = powers(len(data))
    out = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum((data.astype(_U) + _U(1)) * pw, out=out[1:])
    return out


def span_hash(p: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, the same wherever its bytes stand."""
    _, inv = powers(len(p))
    return mix((p[ends] - p[starts]) * inv[starts] + (ends - starts).astype(_U) * MULS[2])


def word_hashes(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, words before each text) of the lower-cased words."""
    starts, ends, first = words(data, off, inside)
    return span_hash(prefix_hash(LOWER[data]), starts, ends), starts, ends, first


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position; the last k - 1 entries of ``h`` start none."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, dtype=_U)
    out = h[:m] * MULS[0]
    for i in range(1, k):
        out += h[i : m + i] * MULS[i]
    return mix(out)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct word k-gram hashes.

    Words are runs of non-space bytes. Fewer than k words make one shingle, none make none.
    """
    h, _, _, first = word_hashes(data, off, IS_SPACE == False)  # noqa: E712
    g = gram_hashes(h, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            yield np.unique(g[a : b - k + 1])
        elif b > a:
            x = _U(b - a) * MULS[12]
            for i in range(b - a):
                x = x + h[a + i] * MULS[i]
            yield mix(np.array([x], dtype=_U))
        else:
            yield np.zeros(0, dtype=_U)
