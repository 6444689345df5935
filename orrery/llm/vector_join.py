"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are rotated to the principal axes of all of them and their axes are dealt out to low-dimensional blocks. If
two vectors lie within the squared distance that the threshold allows, then in some block they lie within that block's share of it
(shares in proportion to the blocks' variance). Each block is range-joined by strips as wide as
its share along its first axis; what comes near in a block is verified exactly. A pair belongs to the first block in
which it is near, so every link is counted once, and only counts and a spanning forest leave a task.

Strips are worth their copies (two a block) only where vectors spread over many of them. Their sizes are counted before a vector moves: a
label whose strips would save less than SAVING of all comparisons is one block with the whole budget, in which every two of its
vectors are compared once, on the leading axes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import _union_find, bounded_batches, components, discard, lookup, sized_broadcast, table

THRESHOLD = 0.93
#: Axes in a block.
BLOCK_DIM = 16
#: Vectors of one side of a comparison; fuller strips are split and compared chunk by chunk.
CHUNK = 2048
#: The same where a label is one block: its vectors move once for each chunk of it.
WHOLE_CHUNK = 16_384
#: Share of a label's comparisons that strips must save.
SAVING = 0.8
#: Leading axes on which vectors of a label that is one block are compared first.
LEAD = 16
#: Above so many dimensions a seeded random rotation takes the place of the principal axes.
MOST_AXES = 512
_LEAST = -(1 << 63)
_SLACK = 1e-9


def _survey(vectors: DataFrame) -> DataFrame:
    """(v, label, dim, key, raw): raw the components as they came, key a digest of label and components; null if it can't link."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, raws, dims = [], [], []
            for label, x in zip(b.column(1).to_pylist(), b.column(2)):
                v = x.values
                a = None
                if label is not None and v is not None and len(v) and not v.null_count:
                    kind = "<f4" if pa.types.is_float32(v.type) else "<f8"
                    a = v.to_numpy(zero_copy_only=False).astype("<f8")
                    norm = float(np.sqrt(a @ a))
                    if not (np.isfinite(a).all() and 0 < norm < np.inf):
                        m = np.abs(a).max()
                        a = a / m if np.isfinite(a).all() and m > 0 else None
                raws.append(None if a is None else a.astype(kind).tobytes())
                dims.append(0 if a is None else len(a))
                keys.append(None if a is None else xxhash.xxh3_128_digest(f"{label}:".encode() + raws[-1]))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], names=["v", "label", "dim", "key", "raw"])

    source = vectors.select(F.coalesce(vectors["vec_id"].cast("long"), F.lit(_LEAST)).alias("v"), vectors["label"].cast("long").alias("label"), vectors["embedding"].alias("e"))
    return source.mapInArrow(scan, "v long, label long, dim int, key binary, raw binary")


def _unit(raw: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    kind = "<f4" if raw and len(raw[0]) == 4 * dim else "<f8"
    x = np.frombuffer(b"".join(raw), dtype=kind).astype(np.float64).reshape(len(raw), -1)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _rotation(per: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(axes as columns, block after block; each block's share): of the unit vectors of that dimension."""
    blocks = max(1, dim // BLOCK_DIM)
    if dim > MOST_AXES:
        axes = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))[0]
        return axes, np.array([len(x) / dim for x in np.array_split(np.arange(dim), blocks)])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dim + 1, dim + 1)), 0
        for b in batches:
            if b.num_rows:
                u = np.c_[_unit(b.column(0).to_pylist(), dim), np.ones(b.num_rows)]
                total += u.T @ u
                n += 1
        if n:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for b in batches:
            for raw in b.column(0).to_pylist():
                total += np.frombuffer(raw).reshape(dim + 1, dim + 1)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["m"])

    parts = per.where(F.col("dim") == dim).select("raw").mapInArrow(moments, "m binary").repartition(8).mapInArrow(add, "m binary").collect()
    m = sum(np.frombuffer(r["m"]).reshape(dim + 1, dim + 1) for r in parts)
    n = max(m[-1, -1], 1.0)
    mean = m[-1, :-1] / n
    var, axes = np.linalg.eigh(m[:-1, :-1] / n - np.outer(mean, mean))
    order = np.argsort(-var, kind="stable")
    deal = [order[i::blocks] for i in range(blocks)]
    share = np.array([max(var[d].sum(), 1e-6) for d in deal])
    return axes[:, np.concatenate(deal)], share / share.sum()


def _edges(dim: int) -> np.ndarray:
    """Where the blocks of a rotated vector start, and its end."""
    blocks = max(1, dim // BLOCK_DIM)
    return np.cumsum([0, *(len(range(i, dim, blocks)) for i in range(blocks))])


def _leading(cut: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` axes of most variance: axes are dealt to the blocks in that order, so they stand first in the blocks."""
    place = np.concatenate([np.arange(b - a) for a, b in zip(cut[:-1], cut[1:])])
    return np.argsort(place, kind="stable")[:n]


def _linked_tile(rot: np.ndarray, unit: np.ndarray, a: np.ndarray, b: np.ndarray, cut: np.ndarray, block: int, most: np.ndarray, threshold: float, near: np.ndarray) -> np.ndarray:
    """Which pairs of a x b are linked and first near in ``block``: products decide what is clear, the rest is computed pair by pair."""

    def split(value: np.ndarray, limit: float, exact) -> np.ndarray:  # noqa: ANN001
        """value <= limit, exactly."""
        out = value <= limit
        i, j = np.nonzero(np.abs(value - limit) <= 1e-9)
        for c in range(0, len(i), 1 << 16):
            x, y = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
            out[x, y] = exact(a[x], b[y]) <= limit
        return out

    own = near
    for k in range(block, -1, -1):  # none where the label is one block
        x, y = rot[a, cut[k] : cut[k + 1]], rot[b, cut[k] : cut[k + 1]]
        d = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
        there = split(d, most[k], lambda m, o, k=k: np.add.reduceat((rot[m] - rot[o]) ** 2, cut[:-1], axis=1)[:, k])
        own = own & there if k == block else own & ~there
    return own & split(-(unit[a] @ unit[b].T), -threshold, lambda m, o: -(unit[m] * unit[o]).sum(axis=1))


def _forest(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, column) that join what ``link`` joins: all of the row with most links, one for what hangs on these, the rest as it is."""
    if not link.any():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    r0 = int(link.sum(axis=1).argmax())
    cols = np.flatnonzero(link[r0])
    with_ = link[:, cols]
    rows = np.flatnonzero(with_.any(axis=1))
    us, vs = [np.full(len(cols), r0), rows], [cols, cols[with_[rows].argmax(axis=1)]]
    more = link[rows]
    more[:, cols] = False
    extra = np.flatnonzero(more.any(axis=0))
    us.append(rows[more[:, extra].argmax(axis=0)])
    vs.append(extra)
    rest = link.copy()
    rest[rows] = False
    i, j = np.nonzero(rest)
    return np.concatenate([*us, i]), np.concatenate([*vs, j])


def _links(per: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(x, y, n): with y null, vector x has n linked rows more; else x and y are joined."""
    axes, share = _rotation(per, dim)
    cut = _edges(dim)
    budget = (2 - 2 * threshold + _SLACK) * share
    width = np.sqrt(budget) * (1 + 1e-9)
    shared = per.sparkSession.sparkContext.broadcast((axes, budget))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, _ = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            r = _unit(b.column(3).to_pylist(), dim) @ turn
            for k in range(len(cut) - 1):
                strip = np.floor(r[:, cut[k]] / width[k]).astype(np.int32)
                for side in (0, 1):
                    yield pa.record_batch([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(np.full(len(strip), k, dtype=np.int32)), pa.array(strip + side), pa.array(np.full(len(strip), side, dtype=np.int32))], names=["nid", "copies", "label", "raw", "block", "strip", "side"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, _ = shared.value
        for b in batches:
            if b.num_rows:
                r = _unit(b.column(1).to_pylist(), dim) @ turn
                at = np.concatenate([np.stack([b.column(0).to_numpy(), np.full(len(r), k), np.floor(r[:, cut[k]] / width[k]).astype(np.int64)], axis=1) for k in range(len(cut) - 1)])
                at, h = np.unique(at, axis=0, return_counts=True)
                yield pa.record_batch([pa.array(at[:, 0]), pa.array(at[:, 1].astype(np.int32)), pa.array(at[:, 2].astype(np.int32)), pa.array(h)], names=["label", "block", "strip", "h"])

    cell = ["label", "block", "strip"]
    own = per.where(F.col("dim") == dim).select("nid", "copies", "label", "raw")
    placed = "nid long, copies long, label long, raw binary, block int, strip int, side int"
    held = own.select("label", "raw").mapInArrow(count, "label long, block int, strip int, h long").groupBy(*cell).agg(F.sum("h").cast("double").alias("h"))
    sides = held.withColumn("g", F.lit(0.0)).unionByName(held.select("label", "block", (F.col("strip") + 1).alias("strip"), F.lit(0.0).alias("h"), F.col("h").alias("g")))
    sizes = table(sides.groupBy(*cell).agg(F.sum("h").alias("h"), F.sum("g").alias("g")))
    cost = sizes.groupBy("label").agg(F.sum(F.col("h") * F.col("h") / 2 + F.col("h") * F.col("g")).alias("strips"), F.sum(F.when(F.col("block") == 0, F.col("h"))).alias("n"))
    whole = table(cost.where(F.col("strips") > (1 - SAVING) * F.col("n") * F.col("n") / 2).select("label", F.ceil(F.col("n") / WHOLE_CHUNK).cast("int").alias("ch")))
    known = sized_broadcast(whole, 24)
    full = sizes.where((F.col("h") > CHUNK) | (F.col("g") > CHUNK)).select(*cell, F.ceil(F.greatest(F.col("h"), F.lit(1)) / CHUNK).cast("int").alias("ch"), F.ceil(F.greatest(F.col("g"), F.lit(1)) / CHUNK).cast("int").alias("cg"))
    alone = own.join(known, "label").select("nid", "copies", "label", "raw", F.lit(-1).alias("block"), F.lit(0).alias("strip"), F.lit(0).alias("side"), "ch", F.lit(0).alias("cg"))
    if whole.count() < cost.count():
        rows = own.join(known, "label", "left_anti").select(*own.columns).mapInArrow(place, placed).join(sized_broadcast(full, 40), cell, "left").select(*alone.columns).unionByName(alone)
    else:
        rows = alone
    mine = F.when(F.col("side") == 0, F.pmod(F.xxhash64("nid"), F.coalesce("ch", F.lit(1)))).otherwise(F.coalesce("ch", F.lit(1)) + F.pmod(F.xxhash64("nid"), F.coalesce("cg", F.lit(1)))).cast("int")
    rows = rows.withColumn("u", mine)
    meets = F.expr("""
        CASE WHEN ch IS NULL THEN array(struct(-1 AS p, -1 AS q))
             WHEN side = 0 THEN concat(transform(sequence(0, ch - 1), x -> struct(least(x, u) AS p, greatest(x, u) AS q)),
                                       IF(cg > 0, transform(sequence(ch, ch + cg - 1), x -> struct(u AS p, x AS q)), array()))
             ELSE transform(sequence(0, ch - 1), x -> struct(x AS p, u AS q)) END""")
    rows = rows.withColumn("meet", F.explode(meets)).select(*cell, "meet.p", "meet.q", "u", "side", "nid", "copies", "raw")
    lead = axes[:, _leading(cut, LEAD)]

    def compare(t: pa.Table) -> pa.Table:
        turn, most = shared.value
        p, q, block = t.column("p")[0].as_py(), t.column("q")[0].as_py(), t.column("block")[0].as_py()
        u, side = t.column("u").to_numpy(), t.column("side").to_numpy()
        nid, copies = t.column("nid").to_numpy(), t.column("copies").to_numpy()
        unit = _unit(t.column("raw").to_pylist(), dim)
        rot = unit @ turn
        a = np.flatnonzero(side == 0 if p < 0 else u == p)
        b = np.flatnonzero(side == 1 if p < 0 else u == q)
        n = np.zeros(len(nid), dtype=np.int64)
        us, vs = [], []
        x = rot[:, cut[block] : cut[block + 1]] if block >= 0 else unit @ lead
        sq, limit = (x * x).sum(axis=1), most[block] if block >= 0 else float(most.sum())
        for left, right, same in ((a, a, True),) * (p < 0 or p == q) + ((a, b, False),) * (p < 0 or p != q):
            step = max(32, min(512, (1 << 21) // max(1, len(right))))
            for i in range(0, len(left), step):
                l = left[i : i + step]  # noqa: E741
                near = sq[l][:, None] + sq[right][None, :] - 2 * (x[l] @ x[right].T) <= limit + 1e-7
                if near.sum() > near.size // 8:  # a cluster: all in matrix products, no list of pairs
                    link = _linked_tile(rot, unit, l, right, cut, block, most, threshold, near)
                    if same:
                        link &= np.arange(i, i + len(l))[:, None] < np.arange(len(right))[None, :]
                    n[l] += link @ copies[right]
                    n[right] += copies[l] @ link
                    eu, ev = _forest(link)
                    us.append(nid[l[eu]])
                    vs.append(nid[right[ev]])
                    continue
                li, ri = np.nonzero(near)
                if same:
                    ok = li + i < ri
                    li, ri = li[ok], ri[ok]
                for c in range(0, len(li), 1 << 16):
                    m, o = l[li[c : c + (1 << 16)]], right[ri[c : c + (1 << 16)]]
                    if block >= 0:
                        d = np.add.reduceat((rot[m] - rot[o]) ** 2, cut[:-1], axis=1) <= most
                        ok = d[:, block] & ~d[:, :block].any(axis=1)
                        m, o = m[ok], o[ok]
                    ok = (unit[m] * unit[o]).sum(axis=1) >= threshold
                    m, o = m[ok], o[ok]
                    np.add.at(n, m, copies[o])
                    np.add.at(n, o, copies[m])
                    if len(m):
                        node, low = _union_find(nid[m], nid[o])
                        us.append(node[node != low])
                        vs.append(low[node != low])
        k = np.flatnonzero(n)
        if not len(k):
            return pa.table({"x": pa.array([], pa.int64()), "y": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        node, low = _union_find(np.concatenate(us), np.concatenate(vs))
        e = node != low
        return pa.table({"x": pa.array(np.r_[nid[k], node[e]]), "y": pa.array([None] * len(k) + low[e].tolist(), pa.int64()), "n": pa.array(np.r_[n[k], np.zeros(int(e.sum()), dtype=np.int64)])})

    return rows.groupBy(*cell, "p", "q").applyInArrow(compare, "x long, y long, n long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label).

    Rows link if their labels are equal and not null and their cosine, in double precision, is at least
    ``threshold``. Null, empty and zero vectors and those with null or non-finite components link with nothing; so do vectors of different
    lengths. Equal rows link with each other. component_id: the smallest vec_id reached by links; kept: the row has that id. A null vec_id
    is never the smallest unless all are null.
    """
    spark = vectors.sparkSession
    bounded_batches(spark, 2000)
    scratch: list[str] = []
    rows = table(_survey(vectors))
    real = F.when(F.col("v") != _LEAST, F.col("v"))
    per = table(rows.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("copies"), F.min(real).alias("least"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("raw").alias("raw")), scratch)
    per = table(per.withColumn("nid", F.monotonically_increasing_id()), scratch)
    dims = sorted(r[0] for r in per.select("dim").distinct().collect())
    found = None
    for d in dims:
        part = _links(per, d, threshold)
        found = part if found is None else found.unionByName(part)
    found = table(found if found is not None else spark.createDataFrame([], "x long, y long, n long"), scratch)
    counts = found.where("y IS NULL").groupBy(F.col("x").alias("nid")).agg(F.sum("n").alias("linked"))
    comp = table(components(found.where("y IS NOT NULL").select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("node", "nid"), scratch)
    small = per.select("key", "nid", "least", "copies")
    low = comp.join(small.select("nid", "least"), "nid").groupBy("component").agg(F.min("least").alias("low"))
    named = lookup(comp, low, "component").select("nid", "low")
    answer = table(small.join(counts, "nid", "left").join(named, "nid", "left").select("key", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("low", "least").alias("low")))
    discard(spark, scratch)
    out = lookup(rows.select(real.alias("vec_id"), "key"), answer, "key").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("low", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
