"""Personal data: exact base kinds plus bootstrapped contextual extraction.

One scan of the texts finds the base kinds and the *mentions*: the values that
stand directly behind a cue word and an assignment sign (``token = "`` ...). Mentions are the edges
of a bipartite graph of lexical patterns (cue, signs, what follows) and instances (values). Seed instances are
values of unmistakable form (base entities; hexadecimal identifiers). Spark scores the graph in
rounds: a pattern is as trustworthy as the share of its instances that are known, instances
of trusted patterns become known in turn, and every mention of a trusted pattern is a span of kind
``secret``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import bounded_batches, lookup, sized_broadcast, table, trim

KINDS = ("email", "ip", "card", "phone")
#: A pattern is trusted from so many distinct instances and this share of known ones.
MIN_SUPPORT = 3
MIN_CONFIDENCE = 0.5
#: Signs of the shortest value that isn't a base span.
LEAST_VALUE = 6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A value behind a cue: a run of such signs; what ends a sentence isn't part of it.
_VALUE = re.compile(r"[A-Za-z0-9_\-./+=~$@!%&*]+")
_TAIL = ".!"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++")
# a match never starts inside a run of digits, so the lookbehind changes nothing but the time taken
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SIGN = re.compile(r"[:=#][\x20\t:=\"']{0,6}")
_CUE = re.compile(r"(?:\A|[^A-Za-z_])([A-Za-z_]{2,24})[\x20\t]{0,3}\Z")
#: Forms that nothing but an identifier has: digests, and 16 lower-case hexadecimal signs or more with letters and digits among them.
_HEX = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{16,})\Z")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(index into KINDS, start, end) by kind, then start; code points, end exclusive."""
    out = []
    last, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > last and text[s - 1] in _LOCAL:
            s -= 1
        if s < at and (m := _DOMAIN.match(text, at)):
            out.append((0, s, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m.group().split(".")):
                out.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            d = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(d) <= 19 and _luhn(d):
                out.append((2, m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, int]]:
    """(start, end, pattern, whether a seed) of the values behind a cue word and an assignment sign.

    A value is a base span that begins there, or else the whole run of token signs if it has 6 at least (a digit or not) and meets no
    base span. Cues are words of 2 to 24 letters.
    """
    out = []
    starts = sorted((s, e) for _, s, e in base)
    at = 0
    for sign in _SIGN.finditer(text):
        s = sign.end()
        if not (cue := _CUE.search(text[max(0, sign.start() - 28) : sign.start()])):
            continue
        while at < len(starts) and starts[at][1] <= s:
            at += 1
        known = at < len(starts) and starts[at][0] == s
        if known:
            s, e = starts[at]
        elif m := _VALUE.match(text, s):
            e = s + len(m.group().rstrip(_TAIL))
            if e - s < LEAST_VALUE or (at < len(starts) and starts[at][0] < e):
                continue
        else:
            continue
        after = text[e : e + 1]
        pattern = f"{cue[1].lower()} {''.join(sign[0].split())} {after if after in '\"' + chr(39) else ''}"
        out.append((s, e, pattern, int(known or bool(_HEX.match(text[s:e])))))
    return out


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows apart by id and text; rows that agree in both have the same results."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), F.hex(F.xxhash64(text)), F.length(text))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, base_sha256, mentions): the one pass over the texts."""
    bounded_batches(docs.sparkSession)
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    mention = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.string()), ("value", pa.string()), ("seed", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bases, digests, named = [], [], []
            for text in b.column(2).to_pylist():
                text = text or ""
                base = base_spans(text)
                bases.append([{"kind": KINDS[k], "start": s, "end": e} for k, s, e in base])
                digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in base).encode()).hexdigest())
                named.append([{"start": s, "end": e, "pattern": p, "value": hashlib.md5(text[s:e].encode()).hexdigest(), "seed": z} for s, e, p, z in mentions(text, base)])
            yield pa.record_batch([b.column(0), b.column(1), pa.array(bases, pa.list_(span)), pa.array(digests, pa.string()), pa.array(named, pa.list_(mention))], names=["doc_id", "key", "base", "base_sha256", "mentions"])
        trim()

    source = docs.select("doc_id", row_key(docs["doc_id"], docs["text"]).alias("key"), "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, key string, base array<struct<kind:string,start:int,end:int>>, base_sha256 string, mentions array<struct<start:int,end:int,pattern:string,value:string,seed:int>>")


def trusted_patterns(edges: DataFrame) -> DataFrame:
    """(pattern, confidence) of the pattern-instance graph ``edges`` (pattern, value, seed), in rounds until none is added."""
    known = edges.groupBy("value").agg(F.max("seed").cast("double").alias("score"))
    before = -1
    while True:  # scores only grow and so does the trusted set: an equal number is an equal set
        stats = edges.join(known, "value").groupBy("pattern").agg(F.count("*").alias("n"), F.avg("score").alias("confidence"))
        good = table(stats.where((F.col("n") >= MIN_SUPPORT) & (F.col("confidence") >= MIN_CONFIDENCE)).select("pattern", "confidence"))
        if (n := good.count()) == before:
            return good
        before = n
        reached = lookup(edges, good, "pattern").groupBy("value").agg(F.greatest(F.max("seed").cast("double"), F.coalesce(F.max("confidence"), F.lit(0.0))).alias("score"))
        known = table(reached)


def extract(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, secrets, base_sha256) for every row; spans are arrays of (kind, start, end) in code points.

    Needs doc_id and text. A null or empty text has no spans; repeated rows get equal results; an
    empty table gives an empty result. A secret never overlaps a base span.
    """
    found = table(scan(docs))
    each = found.select("key", F.explode("mentions").alias("m")).select("key", "m.*")
    edges = table(each.groupBy("pattern", "value").agg(F.max("seed").alias("seed")))
    good = trusted_patterns(edges)
    overlaps = F.expr("exists(base, b -> b.start < m.end AND m.start < b.end)")
    free = table(found.select("key", "base", F.explode("mentions").alias("m")).where(~overlaps).select("key", "m.start", "m.end", "m.pattern"))
    secret = F.struct(F.lit("secret").alias("kind"), F.col("start"), F.col("end"))
    hits = lookup(free, good, "pattern", "inner").groupBy("key").agg(F.sort_array(F.collect_set(secret)).alias("secrets"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    # rows without a mention, repeated ones or ones without a text among them, don't move
    named, plain = (found.where(c).select("doc_id", "key", "base", "base_sha256") for c in (F.size("mentions") > 0, F.size("mentions") == 0))
    return lookup(named, table(hits), "key").withColumn("secrets", F.coalesce("secrets", none)).unionByName(plain.withColumn("secrets", none))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its text replaced by ``<KIND>`` and n_chars (if there is such a column) counted anew."""
    spans = table(extract(docs).select("key", F.concat("base", "secrets").alias("spans")).where(F.size("spans") > 0).dropDuplicates(["key"]))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), row_key(docs["doc_id"], docs["text"]).alias("key"))
    most = 100 + 40 * (spans.agg(F.max(F.size("spans"))).first()[0] or 0)
    joined = keyed.join(sized_broadcast(spans, most), "key", "left")

    @F.pandas_udf("string")
    def mask(text, found):  # noqa: ANN001, ANN202
        def one(t: str | None, sp: object) -> str | None:
            if t is None or sp is None:
                return t
            out, at = [], 0
            for s, e, kind in sorted((x["start"], x["end"], x["kind"]) for x in sp):
                if s >= at:
                    out += [t[at:s], f"<{kind.upper()}>"]
                at = max(at, e)
            return "".join(out) + t[at:]

        return text.combine(found, one)

    hit = F.col("spans").isNotNull()
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns}
    masked = joined.withColumn("new", mask(F.when(hit, columns["text"]), "spans"))  # only texts with spans go to Python
    if "n_chars" in columns:
        columns["n_chars"] = F.when(hit, F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    columns["text"] = F.when(hit, F.col("new")).otherwise(columns["text"])
    return masked.select(*[x.alias(c) for c, x in columns.items()])
