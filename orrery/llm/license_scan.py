"""License scans: exact base phrases, and template matching by diagonal voting.

The rolling word k-gram hashes of all texts are joined with the positions of the license templates
(a constant of this module, so its size is bounded). Hits of one text and template vote for
the diagonal ``position in text - position in template``; neighbouring diagonals merge, and a merged span is verified: the hits that stand in
the template's order, no position of either side twice, must cover enough of it. Templates of one family differ by a word or two, so their k-grams don't tell them
apart: there the telling words inside a span decide its license.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import bounded_batches, lookup, table
from orrery.llm.pii import row_key
from orrery.llm.textbytes import IS_ALNUM, buffers, gram_hashes, pieces, word_hashes

#: Words in a k-gram of the voting.
GRAM = 3
#: Diagonals at most so far apart merge: that many words inserted or dropped between two hits.
DRIFT = 4
#: Share of a template's k-grams that a span must cover.
COVER = 0.6

PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: (label, words); short statements and the characteristic passages of public license texts.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "all rights reserved"),
)

#: (family, part of the label, words): what tells the licenses of a family apart.
MARKS = (
    ("gnu", "gpl", "gnu general"),
    ("gnu", "lgpl", "lesser general"),
    ("gnu", "lgpl", "library general"),
    ("gnu", "agpl", "affero general"),
    ("cc", "nc", "noncommercial"),
    ("cc", "nc", "non commercial"),
    ("cc", "nc", "by nc"),
    ("cc", "sa", "sharealike"),
    ("cc", "sa", "share alike"),
    ("cc", "sa", "by sa"),
    ("cc", "sa", "nc sa"),
    ("cc", "nd", "noderivatives"),
    ("cc", "nd", "noderivs"),
    ("cc", "nd", "no derivatives"),
    ("cc", "nd", "no derivs"),
    ("cc", "nd", "no derivative works"),
    ("cc", "nd", "by nd"),
    ("cc", "nd", "nc nd"),
)
#: Families of the template labels, and the license of a family if no telling word is there.
FAMILY = {"gpl": "gnu", "lgpl": "gnu", "cc-by": "cc", "cc-by-nc": "cc", "cc-by-sa": "cc"}
PLAIN = {"gnu": "gpl", "cc": "cc-by"}
#: Words of a text in a stretch: spans and marks meet by stretches.
STRETCH = 256


def _named(marks: list[tuple[int, int, str, str]]) -> list[dict]:
    """(family, label, at) of the marks (at, words, family, part) of one text; Creative Commons marks that touch make one label."""
    out = [{"family": f, "label": part, "at": at} for at, _, f, part in marks if f != "cc"]
    end, parts = -1, set()
    for at, n, f, part in sorted(marks):
        if f != "cc":
            continue
        if at > end:
            parts = set()
            out.append({"family": f, "label": "", "at": at})
            own = out[-1]
        parts.add(part)
        end = max(end, at + n)
        own["label"] = "-".join(["cc-by", *(x for x in ("nc", "sa", "nd") if x in parts)])
    return out


def _hashes(text: str) -> np.ndarray:
    return word_hashes(*buffers(pa.array([text])), IS_ALNUM)[0]


def template_positions(spark: SparkSession) -> DataFrame:
    """(gram, template, label, family, tpos, n_grams) of every k-gram of every template."""
    rows = []
    for t, (label, text) in enumerate(TEMPLATES):
        g = gram_hashes(_hashes(text), GRAM).view(np.int64).tolist()
        rows += [(x, t, label, FAMILY.get(label), p, len(g)) for p, x in enumerate(g)]
    return spark.createDataFrame(rows, "gram long, template int, label string, family string, tpos int, n_grams int")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_words, base, grams, marks): one pass; grams are those k-grams that any template has, with their places, marks the telling words of texts with such grams."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = np.unique(np.concatenate([gram_hashes(_hashes(t), GRAM) for _, t in TEMPLATES]))
    low = np.zeros(1 << 16, dtype=bool)
    low[known >> np.uint64(48)] = True
    phrases = [(label, _hashes(p)) for p, label in PHRASES]
    telling = [(f, part, _hashes(p)) for f, part, p in MARKS]
    place = pa.struct([("label", pa.string()), ("at", pa.int32())])
    gram = pa.struct([("gram", pa.int64()), ("pos", pa.int32())])
    mark = pa.struct([("family", pa.string()), ("label", pa.string()), ("at", pa.int32())])

    def places(h: np.ndarray, first: np.ndarray, ph: np.ndarray) -> Iterator[tuple[int, int]]:
        """(word, text) of every place of the phrase."""
        hit = np.flatnonzero(h[: max(0, len(h) - len(ph) + 1)] == ph[0])
        for k in range(1, len(ph)):
            hit = hit[h[hit + k] == ph[k]]
        d = np.searchsorted(first, hit, side="right") - 1
        ok = hit + len(ph) <= first[d + 1] if len(hit) else hit.astype(bool)
        return zip(hit[ok].tolist(), d[ok].tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, bases, grams, marks = [], [], [], []
            for i, j, data, off in pieces(b.column(2)):
                h, _, _, first = word_hashes(data, off, IS_ALNUM)
                n_words += np.diff(first).tolist()
                own_b: list[list] = [[] for _ in range(j - i)]
                own_g: list[list] = [[] for _ in range(j - i)]
                for label, ph in phrases:
                    for p, r in places(h, first, ph):
                        own_b[r].append({"label": label, "at": p - int(first[r])})
                g = gram_hashes(h, GRAM)
                hit = np.flatnonzero(low[g >> np.uint64(48)])
                if len(hit):
                    hit = hit[known[np.minimum(np.searchsorted(known, g[hit]), len(known) - 1)] == g[hit]]
                    d = np.searchsorted(first, hit, side="right") - 1
                    ok = hit + GRAM <= first[d + 1]
                    for p, r in zip(hit[ok].tolist(), d[ok].tolist()):
                        own_g[r].append({"gram": int(g[p].view(np.int64)), "pos": p - int(first[r])})
                own_m: list[list] = [[] for _ in range(j - i)]
                if any(own_g):
                    for f, part, ph in telling:
                        for p, r in places(h, first, ph):
                            if own_g[r]:
                                own_m[r].append((p - int(first[r]), len(ph), f, part))
                bases += own_b
                grams += own_g
                marks += map(_named, own_m)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n_words, pa.int64()), pa.array(bases, pa.list_(place)), pa.array(grams, pa.list_(gram)), pa.array(marks, pa.list_(mark))], names=["doc_id", "key", "n_words", "base", "grams", "marks"])

    source = docs.select("doc_id", row_key(docs["doc_id"], docs["text"]).alias("key"), "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, key string, n_words long, base array<struct<label:string,at:int>>, grams array<struct<gram:long,pos:int>>, marks array<struct<family:string,label:string,at:int>>")


def longest_chain(hits: list[tuple[int, int]]) -> int:
    """Most of the (pos, tpos) that can be taken so that both rise."""
    ends: list[int] = []
    for _, t in sorted(hits, key=lambda x: (x[0], -x[1])):
        k = bisect.bisect_left(ends, t)
        ends[k : k + 1] = [t]
    return len(ends)


def in_order(seen: str) -> Column:
    """``longest_chain`` of a column of hits."""

    @F.pandas_udf("int")
    def chain(hits: pd.Series) -> pd.Series:
        return hits.map(lambda xs: longest_chain([(x["pos"], x["tpos"]) for x in xs])).astype("int32")

    return chain(F.col(seen))


def vote(grams: DataFrame, marks: DataFrame) -> DataFrame:
    """(key, label, first, last, cover) of the verified spans; ``grams``: (key, gram, pos), ``marks``: (key, family, label, at).

    A hit votes for its diagonal; per diagonal the votes are counted before anything moves. Diagonals of one text
    and template at most DRIFT apart merge if their places are near, too. A covered span of a family has the licenses that the marks in it name (Creative Commons
    ones may follow directly on it), whichever template of the family covers it.
    """
    templates = template_positions(grams.sparkSession)
    votes = grams.join(F.broadcast(templates), "gram").groupBy("key", "template", "label", "family", "n_grams", (F.col("pos") - F.col("tpos")).alias("diagonal"), F.floor(F.col("pos") / STRETCH).alias("stretch")).agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set(F.struct("pos", "tpos")).alias("seen"))
    w = Window.partitionBy("key", "template").orderBy("diagonal", "first")
    step = (F.col("diagonal") - F.lag("diagonal").over(w) > DRIFT) | (F.abs(F.col("first") - F.lag("last").over(w)) > F.col("n_grams") + DRIFT)
    merged = votes.withColumn("new", F.coalesce(step, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(w))
    spans = merged.groupBy("key", "template", "label", "family", "n_grams", "run").agg(F.min("first").alias("first"), (F.max("last") + GRAM).alias("last"), F.flatten(F.collect_list("seen")).alias("seen"))
    # fewer hits than that can't cover enough in any order
    spans = spans.where(F.size(F.array_distinct(F.col("seen")["tpos"])) >= COVER * F.col("n_grams")).withColumn("n", in_order("seen"))
    cover = F.col("n") / F.col("n_grams")
    found = table(spans.where(cover >= COVER).select("key", "template", "run", "label", "family", "first", "last", cover.alias("cover")))
    alone = found.where("family IS NULL").select("key", "label", "first", "last", "cover")
    stretch = F.explode(F.sequence(F.floor(F.col("first") / STRETCH), F.floor(F.col("last") / STRETCH)))
    near = found.where("family IS NOT NULL").drop("label").withColumn("stretch", stretch)
    named = marks.withColumn("stretch", F.floor(F.col("at") / STRETCH))
    inside = (F.col("at") >= F.col("first")) & (F.col("at") < F.col("last") + (F.col("family") == "cc").cast("int"))
    name = F.collect_set(F.when(inside, F.col("label")))
    told = near.join(named, ["key", "family", "stretch"], "left").groupBy("key", "template", "run", "family", "first", "last", "cover").agg(name.alias("names"))
    plain = F.create_map(*(F.lit(x) for kv in PLAIN.items() for x in kv))[F.col("family")]
    label = F.explode(F.when(F.size("names") > 0, F.col("names")).otherwise(F.array(plain)))
    return alone.unionByName(told.select("key", label.alias("label"), "first", "last", "cover"))


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, base, spans) for every row of ``docs`` (doc_id, text).

    base: (label, at) of the phrases; spans: (label, first, last, cover) of the templates, in
    words. A null or empty text has none; repeated rows get equal results.
    """
    found = table(scan(docs))
    once = table(found.where(F.size("grams") > 0).select("key", "grams", "marks").dropDuplicates(["key"]))
    grams = once.select("key", F.explode("grams").alias("g")).select("key", "g.*")
    spans = vote(grams, once.select("key", F.explode("marks").alias("m")).select("key", "m.*")).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("label", "first", "last", "cover"))).alias("spans"))
    none = F.expr("cast(array() as array<struct<label:string,first:int,last:int,cover:double>>)")
    some, plain = (found.where(c).select("doc_id", "key", "n_words", "base") for c in (F.size("grams") > 0, F.size("grams") == 0))
    out = lookup(some, table(spans), "key").withColumn("spans", F.coalesce("spans", none)).unionByName(plain.withColumn("spans", none))
    return out.drop("key")
