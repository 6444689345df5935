"""Analyzers and term hashing as column expressions."""

from __future__ import annotations

import re
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.errors import SchemaError

#: Letters, digits and the underscore of any script.
TOKEN = r"[\p{L}\p{N}_]+"
_PAIR = np.dtype([("ix", "<u4"), ("w", "<f4")])
ENGLISH_STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")


def analyzer(params: dict[str, Any] | None = None):  # noqa: ANN201
    """A function from a text column to its tokens.

    params: {"tokenizer": "standard" (default) or "jieba", or a dict with "type"; "filter":
    a list of {"stop_words": [...], "type": "stop"}}; ``_english_`` stands for the usual English stop words. "jieba" needs that
    library on the workers.
    """
    params = params or {}
    tokenizer = params.get("tokenizer", params.get("type", "standard"))
    options = tokenizer if isinstance(tokenizer, dict) else {"type": tokenizer}
    stop: list[str] = []
    for f in params.get("filter", []):
        if not isinstance(f, dict) or f.get("type") != "stop":
            raise SchemaError(f"unknown analyzer filter {f!r}")
        for w in f.get("stop_words", []):
            stop += ENGLISH_STOP_WORDS if w == "_english_" else [w.lower()]
    stop += [w.lower() for w in params.get("stop_words", [])]
    kind = options.get("type", "standard")
    if kind not in ("standard", "jieba"):
        raise SchemaError(f"unknown tokenizer {kind!r}")
    base = tokens if kind == "standard" else _jieba(options)

    def run(text: Column) -> Column:
        t = base(text)
        return F.filter(t, lambda x: ~x.isin(*stop)) if stop else t

    return run


def tokens(text: Column) -> Column:
    """Lower-cased words; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def _jieba(options: dict[str, Any]):  # noqa: ANN202
    mode = options.get("mode", "search")

    def run(text: Column) -> Column:
        @F.pandas_udf("array<string>")
        def cut(s):  # noqa: ANN001, ANN202
            import jieba

            t = jieba.Tokenizer()
            for w in options.get("dict", []):
                t.add_word(w)
            how = t.cut_for_search if mode == "search" else t.cut
            return s.map(lambda x: None if x is None else [w.strip().lower() for w in how(x) if w.strip()])

        return cut(text)

    return run


def python_tokens(text: str) -> list[str]:
    """The standard analyzer on the driver, for query strings."""
    return re.findall(r"\w+", text.lower())


def fnv1a(term: Column) -> Column:
    """The 32-bit FNV-1a hash of a term's UTF-8 bytes."""
    hexed = F.hex(term.cast("binary"))
    places = F.sequence(F.lit(0), (F.length(hexed) / 2 - 1).cast("int"))
    parts = F.when(F.length(hexed) > 0, F.transform(places, lambda i: F.conv(F.substring(hexed, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("long")))
    return F.when(F.length(hexed) == 0, F.lit(2166136261)).otherwise(F.aggregate(parts, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * 16777619).bitwiseAND(F.lit(4294967295))))


def term_counts(text_tokens: Column) -> Column:
    """map<term, count>; empty for null. Equal terms are found by one sort."""
    t = F.array_sort(F.coalesce(text_tokens, F.array().cast("array<string>")))

    def bind(value: Column, body):  # noqa: ANN001, ANN202
        """``body`` of a value that is computed once."""
        return F.transform(F.array(value), body)[0]

    def runs(s: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
        return bind(places, lambda p: F.transform(p, lambda i, j: F.struct(F.get(s, i - 1).alias("term"), (F.coalesce(F.get(p, j + 1), F.size(s) + 1) - i).alias("n"))))

    return F.map_from_entries(bind(t, lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(F.array().cast("array<struct<term:string,n:int>>"))))


def sparse_to_bytes(vector: Column) -> Column:
    """A map<index, weight> as packed little-endian (uint32, float32) pairs by index; null for null."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda m: None if m is None else np.array(sorted(dict(m).items()), dtype=_PAIR).tobytes())

    return run(vector)


def sparse_from_bytes(packed: Column) -> Column:
    """The map<index, weight> of packed pairs."""

    @F.pandas_udf("array<struct<ix:long,w:float>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else [{"ix": int(i), "w": float(w)} for i, w in np.frombuffer(b, dtype=_PAIR)])

    return F.map_from_entries(run(packed))
