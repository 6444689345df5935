"""A collection: an append-only mutation log on Parquet and the live view of it.

Layout of a collection's folder, on any file system that Spark reads::

    spec.json  state/NUMBER.json
    data/_append=TAG/_partition=NAME/...   rows with _seq
    deletes/_append=TAG/...                (pk, _seq, _partition)

Every write is an append to a folder of its own, and it counts from the moment that the next state lists the folder: what a
failed append left behind is never read (``recover`` removes it), and its numbers are given out anew. A state is a new file that
must not exist yet, so of two writers one fails; readers need no lock. Snapshots are lists of folders, and no folder that one
lists is removed. Compaction leaves one folder of visible rows, which later reads scan without an aggregate; only the keys of
what was appended since are held against it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery import providers
from orrery.errors import AlreadyExistsError, NotFoundError, QueryError, SchemaError, StateError
from orrery.functions import metrics, temporal, text
from orrery.operators import ann, fulltext, fusion, live
from orrery.operators.knn import check_limits, few_groups, grouped_top_k, limits, order, scored, top_k
from orrery.operators.scan import Range, Weight, best_pairs
from orrery.plans.chain import from_spec, hybrid
from orrery.plans.filter import predicate, to_column
from orrery.plans.projection import output_columns
from orrery.sources.files import Files, Versions
from orrery.schema import INTS, META, CollectionSpec, FieldSpec, conform, problem

DEFAULT_PARTITION = "_default"
ALL_PARTITIONS = "_all"
KEY_BUCKETS = 16
#: Bytes that a file of a compacted partition has about.
COMPACT_BYTES = 128 << 20
#: From so many small appends on, a write merges them into one.
MERGE_APPENDS = 64
#: Exact ones (graphs are answered exactly), approximate ones, and those of sparse and scalar fields.
INDEXES = frozenset("FLAT BRUTE_FORCE AUTOINDEX HNSW HNSW_SQ IVF_FLAT IVF_SQ8 LSH SPARSE_INVERTED_INDEX INVERTED".split())
GROUPABLE = frozenset({"VARCHAR", "BOOL", *INTS})


def key_bucket(value: Column) -> Column:
    """The partition of a partition key: md5 of its text modulo 16, which is the last hex digit."""
    digest = F.md5(F.coalesce(value.cast("string"), F.lit("None")).cast("binary"))
    return F.concat(F.lit("_pk_"), F.conv(F.right(digest, F.lit(1)), 16, 10))


class Collection:
    """Rows, partitions, indexes and state under ``path``."""

    def __init__(self, spark: SparkSession, path: object, name: str | None = None):
        self.spark, self.files = spark, Files(spark, path)
        self.versions = Versions(self.files, "state")
        if not self.files.exists("spec.json"):
            raise NotFoundError(f"no collection at {path}")
        self.name = name or self.files.root.rsplit("/", 1)[-1]
        self.spec = CollectionSpec.from_json(json.dumps(self.files.read("spec.json")))
        self._loaded: DataFrame | None = None

    @staticmethod
    def create(spark: SparkSession, path: object, spec: CollectionSpec, properties: dict | None = None) -> Collection:
        files = Files(spark, path)
        if files.exists("spec.json"):
            raise AlreadyExistsError(f"{path} is a collection")
        files.make()
        names = [f"_pk_{i}" for i in range(KEY_BUCKETS)] if spec.partition_key else []
        start = {"next_seq": 1, "next_id": 1, "partitions": [DEFAULT_PARTITION, *names], "indexes": {}, "load": "released", "properties": properties or {}, "snapshots": {}, "data": [], "deletes": [], "dropped": {}, "batch": -1}
        versions = Versions(files, "state")
        if not versions.exists():
            versions.write(0, start)
        files.write("spec.json", json.loads(spec.to_json()))
        return Collection(spark, path)

    # -- state

    @property
    def path(self) -> str:
        return self.files.root

    @property
    def state(self) -> dict:
        return self.versions.read()[1]

    def _set(self, **change: Any) -> None:
        self._change(lambda s: change)

    def _change(self, of: Callable[[dict], dict]) -> dict:
        """Replaces parts of the state by ``of`` (the state), again if another writer was faster; the state before."""
        while True:
            number, state = self.versions.read()
            if self.versions.write(number, state | of(state)):
                self._forget()
                return state

    def _commit(self, seq: int, data: list[dict] | None = None, deletes: list[dict] | None = None, **more: Any) -> None:
        """Makes appends count whose numbers begin at ``seq``."""

        def change(s: dict) -> dict:
            if s["next_seq"] != seq:
                raise StateError("another writer was faster; nothing was written")
            return {"data": s["data"] + (data or []), "deletes": s["deletes"] + (deletes or []), **more}

        self._change(change)
        if len(self.state["data"]) + len(self.state["deletes"]) > MERGE_APPENDS:
            self.merge_appends()

    def _forget(self) -> None:
        if self._loaded is not None:
            self._loaded.unpersist()
            self._loaded = None

    @property
    def pk(self) -> str:
        return self.spec.primary.name

    @property
    def timezone(self) -> str | None:
        return self.state["properties"].get("timezone")

    def alter_properties(self, properties: dict | None = None, delete_keys: list[str] | None = None) -> None:
        if properties and "timezone" in properties:
            temporal.check_timezone(properties["timezone"])
        p = self.state["properties"] | (properties or {})
        self._set(properties={k: v for k, v in p.items() if k not in (delete_keys or [])})

    # -- frames

    def data(self, state: dict | None = None) -> DataFrame:
        """The log's rows with ``_seq`` and ``_partition``; a filter on ``_partition`` reads those folders only."""
        state = state or self.state
        return self._rows(state["data"], state)

    def _rows(self, entries: list[dict], state: dict) -> DataFrame:
        schema = self.spec.struct(hidden=True)
        rows = self._read("data", entries, schema)
        for name, seq in state["dropped"].items():
            rows = rows.where(~((F.col("_partition") == name) & (F.col("_seq") <= seq)))
        return rows

    def _read(self, what: str, entries: list[dict], schema: T.StructType) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], schema)
        paths = [self.files.at(f"{what}/_append={e['tag']}") for e in entries]
        read = self.spark.read.schema(T.StructType([*schema, T.StructField("_append", T.StringType())]))
        return read.option("basePath", self.files.at(what)).parquet(*paths).select(*[f"`{f.name}`" for f in schema])

    def deletes(self, state: dict | None = None) -> DataFrame:
        kind = self.spec.primary.spark_type()
        schema = T.StructType([T.StructField(self.pk, kind), T.StructField("_seq", T.LongType()), T.StructField("_partition", T.StringType())])
        return self._read("deletes", (state or self.state)["deletes"], schema)

    def live(self, partitions: list[str] | None = None, upto: int | None = None) -> DataFrame:
        """Visible rows with ``_seq`` and ``_partition``."""
        self._known(partitions)
        if partitions is None and upto is None and self._loaded is not None:
            return self._loaded
        return self._visible(self.state, partitions, upto)

    def _visible(self, state: dict, partitions: list[str] | None = None, upto: int | None = None) -> DataFrame:
        deletes = self.deletes(state) if state["deletes"] else None
        base = [e for e in state["data"] if e["live"] and (upto is None or e["high"] <= upto)]
        if not base:
            return live.live_rows(self.data(state), deletes, self.pk, partitions, upto)
        # one row a key, so nothing has to be aggregated, and filters reach the scan
        rows = self._rows(base, state)
        rows = rows if partitions is None else rows.where(F.col("_partition").isin(partitions))
        if deletes is not None:
            rows = live.without_deleted(rows, deletes if upto is None else deletes.where(F.col("_seq") <= upto), self.pk)
        if later := [e for e in state["data"] if not e["live"]]:
            tail = self._rows(later, state)
            tail = tail if partitions is None else tail.where(F.col("_partition").isin(partitions))
            tail = tail if upto is None else tail.where(F.col("_seq") <= upto)
            rows = rows.join(tail.select(self.pk).distinct(), self.pk, "left_anti").select(*rows.columns)
            rows = rows.unionByName(live.live_rows(tail, deletes, self.pk, None, upto))
        return rows

    def _known(self, partitions: list[str] | None) -> None:
        for p in partitions or []:
            if p not in self.state["partitions"]:
                raise NotFoundError(f"no partition is called {p!r}")

    # -- writing

    def frame(self, records: list[dict] | DataFrame) -> DataFrame:
        """Records as rows: keys that no field has stay columns; timestamps are read in the collection's zone."""
        if isinstance(records, DataFrame):
            return records
        times = {f.name for f in self.spec.fields if f.type == "TIMESTAMPTZ"}
        jsons = {f.name for f in self.spec.fields if f.type == "JSON"}
        names: list[str] = []
        for r in records:
            names += [k for k in r if k not in names]
        fields, rows = [], []
        for n in names:
            if n in self.spec:
                fields.append(T.StructField(n, self.spec[n].spark_type()))
            else:
                fields.append(T.StructField(n, T.StringType()))
        dynamic = [n for n in names if n not in self.spec]
        if dynamic and not self.spec.dynamic:
            raise SchemaError(f"unknown fields {', '.join(sorted(dynamic))}")
        for r in records:
            row = {}
            for n in names:
                v = r.get(n)
                if n in times and v is not None:
                    v = temporal.parse_timestamp(v, self.timezone)
                elif n in jsons and v is not None and not isinstance(v, str):
                    v = json.dumps(v)
                elif n in self.spec and v is not None:
                    v = _checked(self.spec[n], v)
                row[n] = v
            rows.append(row)
        if dynamic:
            packed = [json.dumps({k: r[k] for k in sorted(r) if k in dynamic}) if any(k in dynamic for k in r) else None for r in records]
            fields = [f for f in fields if f.name in self.spec] + [T.StructField("$meta", T.StringType())]
            rows = [{n: row[n] for n in names if n in self.spec} | {"$meta": m} for row, m in zip(rows, packed)]
        return self.spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in rows], T.StructType(fields))

    def insert(self, records: list[dict] | DataFrame, partition: str = DEFAULT_PARTITION) -> int:
        """Appends rows (an equal key replaces) and returns their number. The first broken rule fails the whole call before anything is written."""
        state = self.state
        entries, change, n = self._append(records, partition, state)
        self._commit(state["next_seq"], entries, **change)
        return n

    def _append(self, records: list[dict] | DataFrame, partition: str, state: dict) -> tuple[list[dict], dict, int]:
        """Writes rows with the next numbers, not counting yet: (appends, change of the state, rows)."""
        self._known([partition])
        rows = conform(self.frame(records), self.spec)
        pk = self.spec.primary
        rows = self._apply_functions(rows)
        staged = f"staged-{uuid.uuid4().hex}"
        try:
            rows.withColumn("_n", F.monotonically_increasing_id()).write.parquet(self.files.at(staged))
            back = self.spark.read.parquet(self.files.at(staged))
            bad = back.select(problem(self.spec).alias("p")).where("p IS NOT NULL").limit(1).collect()
            if bad:
                raise SchemaError(bad[0].p)
            placed, n = numbered(back, state["next_seq"])
            if pk.auto_id:
                placed = placed.withColumn(pk.name, F.col("_seq") - state["next_seq"] + state["next_id"])
            where = key_bucket(F.col(f"`{self.spec.partition_key.name}`")) if self.spec.partition_key else F.lit(partition)
            entries = [self._write(placed.withColumn("_partition", where), state["next_seq"], state["next_seq"] + n - 1)] if n else []
        finally:
            self.files.remove(staged)
        return entries, {"next_seq": state["next_seq"] + n, "next_id": state["next_id"] + (n if pk.auto_id else 0)}, n

    def _write(self, rows: DataFrame, low: int, high: int, live: bool = False) -> dict:
        """A folder of the log with ``rows``; fields with an inverted index get Bloom filters."""
        tag = f"a{uuid.uuid4().hex[:16]}"
        out = rows.write.partitionBy("_partition")
        for field, info in self.state["indexes"].items():
            if info["index_type"] == "INVERTED":
                out = out.option(f"parquet.bloom.filter.enabled#{field}", "true")
        out.parquet(self.files.at(f"data/_append={tag}"))
        return {"tag": tag, "low": low, "high": high, "live": live}

    def _apply_functions(self, rows: DataFrame) -> DataFrame:
        for f in self.spec.functions:
            if f.type == "BM25":
                counts = text.term_counts(text.analyzer(self.spec[f.input].analyzer)(F.col(f"`{f.input}`")))
                hashed = F.map_from_entries(F.transform(F.map_entries(counts), lambda e: F.struct(text.fnv1a(e["key"]), e["value"].cast("float"))))
                rows = rows.withColumn(f.output, hashed)
            else:
                embed = providers.embedder(f.params, self.spec[f.output].dim)
                rows = rows.withColumn(f.output, embed(F.col(f"`{f.input}`")))
        return rows

    def upsert(self, records: list[dict] | DataFrame, partition: str = DEFAULT_PARTITION) -> int:
        """Inserts rows, completed from the live rows with the same key where a record lacks a field."""
        if isinstance(records, DataFrame) or not records:
            return self._upsert_part(self.frame(records), partition) if isinstance(records, DataFrame) else 0
        # records with the same keys share one overlay: a missing key keeps the old value, a key that is null clears it
        parts: dict[tuple, list[dict]] = {}
        for r in records:
            parts.setdefault(tuple(sorted(r)), []).append(r)
        return sum(self._upsert_part(self.frame(p), partition) for p in parts.values())

    def _upsert_part(self, changes: DataFrame, partition: str) -> int:
        if self.pk not in changes.columns:
            raise SchemaError(f"{self.pk} is missing")
        columns = [f.name for f in self.spec.fields if f.name not in self.spec.outputs] + (["$meta"] if self.spec.dynamic else [])
        return self.insert(live.overlay(self.live(), changes, self.pk, columns), partition)

    def delete(self, pks: list, partition: str | None = None) -> int:
        """Tombstones for keys, all with one ``_seq``; they hide the key in every partition."""
        self._known([partition] if partition else None)
        return self._bury(self.spark.createDataFrame([(p,) for p in pks], T.StructType([T.StructField(self.pk, self.spec.primary.spark_type())])), partition)

    def delete_where(self, expr: str, partition: str | None = None) -> int:
        """Deletes the live rows that match; the matching keys never leave the cluster."""
        self._known([partition] if partition else None)
        found = self.live([partition] if partition else None).where(predicate(expr, self.spec, self.timezone)).select(self.pk)
        return self._bury(found, partition)

    def _bury(self, keys: DataFrame, partition: str | None) -> int:
        seq = self.state["next_seq"]
        entries, n = self._tombstones(keys, partition, seq)
        self._commit(seq, deletes=entries, next_seq=seq + 1)
        return n

    def _tombstones(self, keys: DataFrame, partition: str | None, seq: int) -> tuple[list[dict], int]:
        """Writes tombstones with the number ``seq``, not counting yet: (appends, their number)."""
        tag = f"a{uuid.uuid4().hex[:16]}"
        at = self.files.at(f"deletes/_append={tag}")
        keys.select(self.pk, F.lit(seq).cast("long").alias("_seq"), F.lit(partition or ALL_PARTITIONS).alias("_partition")).write.parquet(at)
        n = self.spark.read.parquet(at).count()
        return ([{"tag": tag, "low": seq, "high": seq}] if n else []), n

    def apply(self, rows: DataFrame | None, gone: DataFrame | None, batch: int) -> bool:
        """Writes rows, then tombstones, and counts them as batch ``batch`` in one change of state; False if that batch was counted before."""
        state = self.state
        if state["batch"] >= batch:
            return False
        entries, change, _ = self._append(rows, DEFAULT_PARTITION, state) if rows is not None else ([], {"next_seq": state["next_seq"]}, 0)
        deletes = []
        if gone is not None:
            deletes, _ = self._tombstones(gone, None, change["next_seq"])
            change["next_seq"] += 1
        self._commit(state["next_seq"], entries, deletes, **change, batch=batch)
        return True

    # -- reading

    def _where(self, rows: DataFrame, expr: str | None, timezone: str | None) -> DataFrame:
        return rows.where(predicate(expr, self.spec, timezone or self.timezone)) if expr else rows

    def query(self, expr: str | None = None, output_fields: list[str] | None = None, partitions: list[str] | None = None, limit: int | None = None, offset: int = 0, timezone: str | None = None) -> DataFrame:
        """Matching rows; with a limit or an offset in the order of the primary key. ``["count(*)"]`` counts them."""
        self._need_loaded()
        rows = self._where(self.live(partitions), expr, timezone)
        if output_fields == ["count(*)"]:
            return rows.agg(F.count(F.lit(1)).alias("count(*)"))
        if limit is not None or offset:
            if offset < 0 or (limit is not None and limit < 0):
                raise QueryError("limit and offset aren't negative")
            rows = rows.orderBy(self.pk).offset(offset)
            rows = rows if limit is None else rows.limit(limit)
        return rows.select(*output_columns(self.spec, output_fields))

    def get(self, pks: list | DataFrame, output_fields: list[str] | None = None, partitions: list[str] | None = None, expr: str | None = None) -> DataFrame:
        """The rows of the keys in their order, a key given twice twice, missing ones left out.

        A frame (pos, key) of any size is joined as it is, and pos becomes the first column of the result, which has no order.
        """
        self._need_loaded()
        live_ = self.live(partitions)
        shown = output_columns(self.spec, output_fields)
        if isinstance(pks, DataFrame):
            wanted = pks.select(F.col("pos").alias("_pos"), F.col("key").alias("_want"))
            return self._where(live_, expr, None).join(wanted, F.col(self.pk) == F.col("_want")).select(F.col("_pos").alias("pos"), *shown)
        wanted = self.spark.createDataFrame([(i, p) for i, p in enumerate(pks)], T.StructType([T.StructField("_pos", T.LongType()), T.StructField("_want", self.spec.primary.spark_type())]))
        rows = self._where(live_.where(F.col(self.pk).isin(list(set(pks)))), expr, None)
        return rows.join(F.broadcast(wanted), F.col(self.pk) == F.col("_want")).orderBy("_pos").select(*shown)

    def search(self, queries: list | DataFrame, limit: int = 10, metric: str | None = None, *, field: str | None = None, expr: str | None = None, partitions: list[str] | None = None, output_fields: list[str] | None = None, offset: int = 0, radius: float | None = None, range_filter: float | None = None, group_by: str | None = None, group_size: int = 1, strict_group_size: bool = False, ranker: dict | None = None, timezone: str | None = None, chain: list[dict] | None = None, digits: int | None = None) -> DataFrame:
        """(qid, id, distance, rank, fields ...): the best rows of each query.

        queries: vectors, texts (for a BM25 or embedded field), or a frame (qid, qvector), for a BM25 field (qid, its input field). distance is the public score. Order of the
        steps: filter, score, boost, range, groups or top-k, then the rerank ``chain`` (its $score starts as the distance, BM25 as the positive
        relevance), then rounding to ``digits``. A chain excludes a boost ranker.
        """
        self._need_loaded()
        f = self._search_field(field)
        fields = ["*"] if output_fields is None else output_fields
        if group_by is not None and (group_by not in self.spec or self.spec[group_by].type not in GROUPABLE):
            raise QueryError(f"{group_by!r} can't be grouped by")
        rows = self.live(partitions)
        cond = predicate(expr, self.spec, timezone or self.timezone) if expr else None
        if f.type == "SPARSE_FLOAT_VECTOR":
            hits, metric = self._sparse_hits(f, rows, queries, cond), "BM25"
        else:
            metric = metrics.check_metric(metric or self._index_metric(f.name) or "COSINE")
            q = self._query_frame(queries, f)
            rows = rows if cond is None else rows.where(cond)
            ranged = radius is not None or range_filter is not None
            if (ranker and ranged) or (group_by is not None and not few_groups(rows, group_by)):  # a range of boosted scores; any number of groups
                hits = scored(rows, q, metric, f.name)
            else:
                check_limits(limit, offset)
                hits = self._best_hits(rows, q, metric, f, group_size if group_by else limit + offset, group_by, limits(metric, radius, range_filter), ranker, self._columns(rows, fields, group_by, everything=bool(chain or ranker)))
        hits = hits.withColumn("id", F.col(self.pk))
        if ranker:
            hits = hits.withColumn("score", self._boosted(F.col("score"), metric, ranker))
        if radius is not None or range_filter is not None:
            hits = hits.where(metrics.in_range(metric, F.col("score"), radius, range_filter))
        if group_by is not None:
            out = grouped_top_k(hits, order(metric), group_by, limit, group_size, strict_group_size, offset)
            extra = ["group_rank"]
        else:
            out, extra = top_k(hits, order(metric), limit, offset), []
        shown = output_columns(self.spec, fields, search=True)
        if chain is not None:
            if ranker is not None:
                raise QueryError("a chain and a ranker exclude each other")
            times = {x.name for x in self.spec.fields if x.type == "TIMESTAMPTZ"}
            if metric == "BM25":
                out = out.withColumn("score", -F.col("score"))
            out = from_spec(chain, out.columns, times).execute(out)
        score = F.col("score") if digits is None else fusion.round_decimal(F.col("score"), digits)
        return out.select("qid", "id", score.alias("distance"), "rank", *extra, *shown)

    def _columns(self, rows: DataFrame, fields: list[str], group_by: str | None, everything: bool) -> list[str]:
        """Columns of ``rows``, without the key, that a result with ``fields`` is made of."""
        others = [c for c in rows.columns if c not in (self.pk, "_seq", "_partition")]
        if everything or "*" in fields:
            return others
        dynamic = any(n not in self.spec for n in fields)
        return [c for c in others if c in fields or c == group_by or (dynamic and c == META)]

    def _best_hits(self, rows: DataFrame, queries: DataFrame, metric: str, f: FieldSpec, k: int, group_by: str | None, within: Range | None, ranker: dict | None, carry: list[str]) -> DataFrame:
        weight = None
        if ranker:
            functions, function_mode, boost_mode = self._functions(ranker)
            any_, value = fusion.boost_value(functions, function_mode)
            fusion.boost_by(F.lit(0.0), metric, any_, value, boost_mode)
            weight = Weight(boost_mode, value, any_)
        return best_pairs(rows, queries, metric, k, vector=f.name, id_col=self.pk, carry=carry, group=group_by, within=within, weight=weight)

    def hybrid_search(self, requests: list[dict], rerank: str = "rrf", limit: int = 10, *, offset: int = 0, group_by: str | None = None, group_size: int = 1, digits: int | None = None, output_fields: list[str] | None = None, decay: dict | None = None, **merge: Any) -> DataFrame:
        """(qid, id, score, rank, fields ...): several searches fused.

        requests: arguments of ``search`` ({"queries", "limit", "field", "metric", ...}); rerank: rrf, weighted, max, sum or avg with its
        parameters (k, weights, norm_score, force_descending) in ``merge``; decay: {"field", "function", "origin", "scale", ...}, a factor on the
        fused score. All routes and the fusion are one plan.
        """
        if not requests:
            raise QueryError("there is no request")
        of = dict(decay or {})
        # with one version of each row for all routes, they carry what the fusion needs; the other fields are looked up for its hits
        late = not any(r.get("partitions") for r in requests)
        needed = [c for c in dict.fromkeys([group_by, of.get("field")]) if c is not None] if late else ["*"]
        routes = []
        for r in requests:
            f = self._search_field(r.get("field"))
            metric = "BM25" if f.type == "SPARSE_FLOAT_VECTOR" else metrics.check_metric(r.get("metric") or self._index_metric(f.name) or "COSINE")
            hits = self.search(**(r | {"output_fields": needed})).withColumnRenamed("distance", "score").drop("rank")
            # a relevance, so that normalised scores and sorts have one direction
            routes.append((hits.withColumn("score", -F.col("score")) if metric == "BM25" else hits, metric))
        out = hybrid(routes, rerank, limit, offset=offset, group=group_by, group_size=group_size, digits=digits, decay_of=of.pop("field", None), decay_params=of, **merge)
        shown = output_columns(self.spec, ["*"] if output_fields is None else output_fields, search=True)
        extra = ["group_rank", "group_score"] if group_by else []
        own = ["qid", "id", "score", "rank", *extra]
        if late:
            found = self.live()
            out = found.join(out.select(*[F.col(c).alias(f"_hit_{c}") for c in own]), F.col(self.pk) == F.col("_hit_id"))
            return out.select(*[F.col(f"_hit_{c}").alias(c) for c in own], *shown)
        return out.withColumn(self.pk, F.col("id")).select(*own, *shown) if self.pk != "id" else out.select(*own, *shown)

    def search_index(self, queries: list | DataFrame, limit: int = 10, field: str | None = None, nprobe: int | None = None) -> DataFrame:
        """(qid, id, score, rank) by the field's inverted-list or projection index, which is written anew if rows have changed since."""
        f = self._search_field(field)
        info = self.state["indexes"].get(f.name)
        if not info or info["index_type"] not in ("IVF_FLAT", "IVF_SQ8", "LSH"):
            raise NotFoundError(f"{f.name} has no approximate index")
        rows, facts = self.build_index(f.name)
        q = self._query_frame(queries, f)
        if info["index_type"] == "LSH":
            return ann.search_lsh(rows, q, info["metric_type"], limit, f.dim, facts["tables"], facts["bits"])
        return ann.search_ivf(ann.IvfIndex(rows, np.array(facts["centroids"]), info["metric_type"], nprobe=facts["nprobe"]), q, limit, nprobe)

    def build_index(self, field: str) -> tuple[DataFrame, dict]:
        """The written index of a field, lists as folders, and its facts; built if there is none for the present rows."""
        f, info, state = self.spec[field], self.index_info(field), self.state
        at = self.files.sub(f"index-{field}")
        facts = at.read("facts.json") if at.exists("facts.json") else {}
        if facts.get("seq") != state["next_seq"] or facts.get("info") != info:
            at.remove()
            at.make()
            facts = {"seq": state["next_seq"], "info": info}
            if info["index_type"] == "LSH":
                tables = info["params"].get("tables", ann.TABLES)
                bits = info["params"].get("bits") or ann.fit_lsh(self.live(), info["metric_type"], f.dim, tables, vector=field, id_col=self.pk)
                facts |= {"tables": tables, "bits": bits}
                ann.build_lsh(self.live(), tables, bits, vector=field, id_col=self.pk, dim=f.dim).write.parquet(at.at("rows"))
            else:
                built = ann.build_ivf(self.live(), info["metric_type"], info["params"].get("nlist"), sq8=info["index_type"] == "IVF_SQ8", vector=field, id_col=self.pk)
                built.write(at.at("rows"))
                facts |= {"centroids": built.centroids.tolist(), "nprobe": built.nprobe}
            at.write("facts.json", facts)
        return self.spark.read.parquet(at.at("rows")), facts

    def _search_field(self, field: str | None) -> FieldSpec:
        if field is not None:
            f = self.spec[field]
            if f.type not in ("FLOAT_VECTOR", "SPARSE_FLOAT_VECTOR"):
                raise QueryError(f"{field} is no vector field")
            return f
        for f in self.spec.fields:
            if f.type == "FLOAT_VECTOR":
                return f
        raise QueryError("say which sparse field to search")

    def _index_metric(self, field: str) -> str | None:
        return (self.state["indexes"].get(field) or {}).get("metric_type")

    def _query_frame(self, queries: list | DataFrame, f: FieldSpec) -> DataFrame:
        if isinstance(queries, DataFrame):
            return queries
        if queries and isinstance(queries[0], str):
            fn = next((x for x in self.spec.functions if x.output == f.name and x.type == "TEXT_EMBEDDING"), None)
            if fn is None:
                raise QueryError(f"{f.name} can't be searched by text")
            embed = providers.embedder(fn.params, f.dim)
            return self.spark.createDataFrame(list(enumerate(queries)), "qid long, _t string").select("qid", embed(F.col("_t")).alias("qvector"))
        for q in queries:
            if len(q) != f.dim:
                raise QueryError(f"{f.name} has {f.dim} components, a query {len(q)}")
        return self.spark.createDataFrame([(i, [float(x) for x in q]) for i, q in enumerate(queries)], "qid long, qvector array<double>")

    def _sparse_hits(self, f: FieldSpec, rows: DataFrame, queries: list | DataFrame, cond: Column | None) -> DataFrame:
        fn = next((x for x in self.spec.functions if x.output == f.name and x.type == "BM25"), None)
        texts = fn.input in queries.columns if fn is not None and isinstance(queries, DataFrame) else bool(queries) and isinstance(queries[0], str)
        if fn is not None and texts:
            q = queries if isinstance(queries, DataFrame) else self.spark.createDataFrame(list(enumerate(queries)), f"qid long, `{fn.input}` string")
            found = fulltext.bm25_scores(rows, q, text.analyzer(self.spec[fn.input].analyzer), text=fn.input, id_col=self.pk, where=cond)
        else:
            q = queries if isinstance(queries, DataFrame) else self.spark.createDataFrame([(i, {int(k): float(v) for k, v in x.items()}) for i, x in enumerate(queries)], "qid long, qvector map<bigint,double>")
            found = fulltext.sparse_scores(rows if cond is None else rows.where(cond), q, vector=f.name, id_col=self.pk)
        found = found.select("qid", F.col("id").alias("_id"), (-F.col("score")).alias("score"))
        return rows.join(found, F.col(self.pk) == F.col("_id")).drop("_id")

    def _boosted(self, score: Column, metric: str, ranker: dict) -> Column:
        functions, function_mode, boost_mode = self._functions(ranker)
        return fusion.boost(score, metric, functions, function_mode, boost_mode)

    def _functions(self, ranker: dict) -> tuple[list[tuple[Column | None, Column]], str, str]:
        functions = []
        for f in ranker.get("functions", []):
            p = f.get("params", f)
            cond = to_column(p["filter"], self.spec, self.timezone) if p.get("filter") else None
            weight: Column = F.lit(float(p["weight"]))
            if (r := p.get("random_score")) is not None:
                of = r.get("field") or self.pk
                weight = weight * fusion.random_score(F.col(f"`{of}`"), r.get("seed", 0), self.spec[of].type == "VARCHAR")
            functions.append((cond, weight))
        p = ranker.get("params", {})
        return functions, p.get("function_mode", "multiply"), p.get("boost_mode", "multiply")

    def query_iterator(self, expr: str | None = None, batch: int = 1000, output_fields: list[str] | None = None) -> Iterator[DataFrame]:
        """Pages of matching rows by primary key; each page is a keyset query of its own."""
        last = None
        while True:
            rows = self._where(self.live(), expr, None)
            if last is not None:
                rows = rows.where(F.col(self.pk) > last)
            page = rows.orderBy(self.pk).limit(batch).select(*output_columns(self.spec, output_fields))
            end = page.agg(F.max(self.pk)).first()[0]
            if end is None:
                return
            yield page
            last = end

    def search_iterator(self, vector: list, metric: str = "COSINE", batch: int = 100, field: str | None = None) -> Iterator[DataFrame]:
        """Pages of hits of one query, best first: after a page come those with a worse score, or the same and a larger id."""
        f = self._search_field(field)
        up = metric in metrics.ASCENDING
        last = None
        while True:
            hits = scored(self.live(), self._query_frame([vector], f), metric, f.name).select(F.col(self.pk).alias("id"), "score")
            if last is not None:
                s, i = last
                worse = F.col("score") > s if up else F.col("score") < s
                hits = hits.where(worse | ((F.col("score") == s) & (F.col("id") > i)))
            page = hits.orderBy(*order(metric)).limit(batch)
            rows = page.collect()  # one page
            if not rows:
                return
            yield self.spark.createDataFrame(rows, page.schema)
            last = (rows[-1].score, rows[-1].id)

    def num_entities(self, partition: str | None = None) -> int:
        return self.live([partition] if partition else None).count()

    def partition_counts(self) -> DataFrame:
        return self.live().groupBy("_partition").count()

    def export_json(self, path: str, expr: str | None = None) -> None:
        """Live rows as JSON lines; a key that numbers itself is left out."""
        rows = self._where(self.live(), expr, None).drop("_seq", "_partition")
        (rows.drop(self.pk) if self.spec.primary.auto_id else rows).write.json(path)

    # -- partitions, indexes, loading

    def create_partition(self, name: str) -> None:
        if self.spec.partition_key:
            raise StateError("partitions follow the partition key")
        parts = self.state["partitions"]
        if name in parts or name == ALL_PARTITIONS:
            raise AlreadyExistsError(f"there is a partition {name!r}")
        self._set(partitions=[*parts, name])

    def drop_partition(self, name: str) -> None:
        if self.spec.partition_key or name == DEFAULT_PARTITION:
            raise StateError(f"{name} can't be dropped")
        self._known([name])
        self._change(lambda s: {"partitions": [p for p in s["partitions"] if p != name], "dropped": s["dropped"] | {name: s["next_seq"] - 1}})

    def has_partition(self, name: str) -> bool:
        known = self.list_partitions()
        return name in known

    def list_partitions(self) -> list[str]:
        return list(self.state["partitions"])

    def create_index(self, field: str, index_type: str, metric_type: str | None = None, params: dict | None = None) -> None:
        f = self.spec[field]
        if index_type not in INDEXES:
            raise QueryError(f"unknown index type {index_type}")
        dense = f.type == "FLOAT_VECTOR"
        if dense and metric_type not in ("COSINE", "IP", "L2"):
            raise QueryError("a vector index needs COSINE, IP or L2")
        if (index_type == "INVERTED") == (f.type in ("FLOAT_VECTOR", "SPARSE_FLOAT_VECTOR")):
            raise QueryError(f"{index_type} doesn't fit a {f.type}")
        if field in self.state["indexes"]:
            raise AlreadyExistsError(f"{field} has an index")
        self._set(indexes=self.state["indexes"] | {field: {"index_type": index_type, "metric_type": metric_type, "params": params or {}}})

    def drop_index(self, field: str) -> None:
        if self.state["load"] == "loaded":
            raise StateError("release the collection before its index is dropped")
        if field not in self.state["indexes"]:
            raise NotFoundError(f"{field} has no index")
        self._set(indexes={k: v for k, v in self.state["indexes"].items() if k != field})

    def has_index(self, field: str | None = None) -> bool:
        return bool(self.state["indexes"]) if field is None else field in self.state["indexes"]

    def list_indexes(self) -> list[str]:
        return sorted(self.state["indexes"])

    def index_info(self, field: str) -> dict:
        if field not in self.state["indexes"]:
            raise NotFoundError(f"{field} has no index")
        return {"field": field, **self.state["indexes"][field]}

    def load(self) -> None:
        """Caches the live rows, spilling to disk what memory can't hold."""
        self._set(load="loaded")
        self._loaded = self.live().persist()

    def release(self) -> None:
        self._set(load="released")

    def _need_loaded(self) -> None:
        s = self.state
        if s["indexes"] and s["load"] != "loaded":
            raise StateError("the collection has indexes but isn't loaded")

    @property
    def load_state(self) -> str:
        return self.state["load"]

    def flush(self) -> None:
        """Nothing to do: every write is on disk when it returns."""

    def close(self) -> None:
        self._forget()

    def describe(self) -> dict:
        s = self.state
        return {"name": self.name, "fields": [f.name for f in self.spec.fields], "partitions": s["partitions"], "indexes": s["indexes"], "load_state": s["load"], "properties": s["properties"], "num_entities": self.num_entities()}

    # -- maintenance

    def truncate(self) -> None:
        """No rows any more; partitions, indexes and state stay."""
        self._replace(lambda s: {"data": [], "deletes": [], "dropped": {}})

    def compact(self) -> None:
        """Rewrites the log to the visible rows and drops all tombstones; snapshots keep their folders.

        Rows are sorted by the fields that have an inverted index (then ``_seq``), so that a filter on them skips row groups.
        """
        state = self.state
        size = sum(self.files.size(f"data/_append={e['tag']}") for e in state["data"])
        by = ["_partition", *(f for f, x in state["indexes"].items() if x["index_type"] == "INVERTED"), "_seq"]
        rows = self._visible(state).repartitionByRange(max(1, -(-size // COMPACT_BYTES)), *by).sortWithinPartitions(*by)
        entry = self._write(rows, 1, state["next_seq"] - 1, live=True)
        self._replace(lambda s: {"data": [entry], "deletes": [], "dropped": {}}, state)

    def merge_appends(self) -> None:
        """Merges the appends that are smaller than COMPACT_BYTES, tombstones too, each kind to one folder; no row changes."""
        state = self.state
        small = [e for e in state["data"] if not e["live"] and self.files.size(f"data/_append={e['tag']}") < COMPACT_BYTES]
        change = {}
        if len(small) > 1:
            rows = self._rows(small, state)
            entry = self._write(rows.repartitionByRange(max(1, rows.rdd.getNumPartitions() // 64), "_partition", "_seq"), small[0]["low"], small[-1]["high"])
            gone = {e["tag"] for e in small}
            change["data"] = sorted([e for e in state["data"] if e["tag"] not in gone] + [entry], key=lambda e: e["low"])
        if len(state["deletes"]) > 1:
            tag = f"a{uuid.uuid4().hex[:16]}"
            self.deletes(state).coalesce(1 + len(state["deletes"]) // 64).write.parquet(self.files.at(f"deletes/_append={tag}"))
            change["deletes"] = [{"tag": tag, "low": state["deletes"][0]["low"], "high": state["deletes"][-1]["high"]}]
        if change:
            self._replace(lambda s: change, state)

    def collect_tombstones(self) -> None:
        """Drops the tombstones that no row of the log is older than; the smallest number of each append is known without reading it."""
        state = self.state
        if not state["data"]:
            self._replace(lambda s: {"deletes": []}, state)
            return
        low = self.data(state).agg(F.min("_seq")).first()[0] if any(e["live"] for e in state["data"]) else min(e["low"] for e in state["data"])
        kept = [e for e in state["deletes"] if low is not None and e["high"] > low]
        self._replace(lambda s: {"deletes": kept}, state)

    def _replace(self, of: Callable[[dict], dict], seen: dict | None = None) -> None:
        """Changes the lists of folders, unless something was written since ``seen``, and removes the folders that nothing lists any more."""

        def change(s: dict) -> dict:
            if seen is not None and s["next_seq"] != seen["next_seq"]:
                raise StateError("another writer was faster; nothing was replaced")
            return of(s)

        self._drop_unlisted(self._change(change))

    def _listed(self, state: dict) -> set[str]:
        return {f"{k}/_append={e['tag']}" for s in (state, *state["snapshots"].values()) for k in ("data", "deletes") for e in s[k]}

    def _drop_unlisted(self, before: dict) -> None:
        for f in self._listed(before) - self._listed(self.state):
            self.files.remove(f)

    def recover(self) -> int:
        """Removes what failed writes have left behind and returns the number of folders; not while another writer is at work."""
        listed, n = self._listed(self.state), 0
        left = [f"{k}/{x}" for k in ("data", "deletes") for x in self.files.list(k) if x.startswith("_append=")]
        for f in [x for x in left if x not in listed] + [x for x in self.files.list() if x.startswith("staged-")]:
            self.files.remove(f)
            n += 1
        return n

    def create_snapshot(self, name: str, description: str = "") -> None:
        def change(s: dict) -> dict:
            if name in s["snapshots"]:
                raise AlreadyExistsError(f"there is a snapshot {name!r}")
            return {"snapshots": s["snapshots"] | {name: {"seq": s["next_seq"] - 1, "description": description, **{k: s[k] for k in ("data", "deletes", "dropped", "partitions")}}}}

        self._change(change)

    def list_snapshots(self) -> list[str]:
        return sorted(self.state["snapshots"])

    def drop_snapshot(self, name: str) -> None:
        if name not in self.state["snapshots"]:
            raise NotFoundError(f"no snapshot is called {name!r}")
        self._replace(lambda s: {"snapshots": {k: v for k, v in s["snapshots"].items() if k != name}})

    def snapshot_rows(self, name: str) -> DataFrame:
        """The rows that were visible when the snapshot was made, those of partitions dropped since included."""
        if name not in self.state["snapshots"]:
            raise NotFoundError(f"no snapshot is called {name!r}")
        return self._visible(self.state["snapshots"][name])


def numbered(rows: DataFrame, base: int) -> tuple[DataFrame, int]:
    """``rows`` (with the increasing ``_n`` of a written table) with consecutive ``_seq`` from ``base``, and their number.

    Offsets of the parts of ``_n`` are sums of the parts' counts; no row moves.
    """
    part = F.shiftright("_n", 33)
    counts = {r[0]: r[1] for r in rows.groupBy(part.alias("p")).count().collect()}  # one row per task of the write
    offsets, at = [], base
    for p in sorted(counts):
        offsets.append((p, at - (p << 33)))
        at += counts[p]
    shift = rows.sparkSession.createDataFrame(offsets, "p long, shift long")
    return rows.join(F.broadcast(shift), part == F.col("p")).withColumn("_seq", F.col("_n") + F.col("shift")).drop("p", "shift", "_n"), at - base


def _checked(f: FieldSpec, v: Any) -> Any:
    """A value of a record as Spark takes it, or an error."""
    if f.type == "FLOAT_VECTOR":
        return [float(x) for x in v]
    if f.type == "SPARSE_FLOAT_VECTOR":
        return {int(k): float(x) for k, x in v.items()}
    if f.type in ("FLOAT", "DOUBLE"):
        if isinstance(v, bool) or not isinstance(v, int | float):
            raise SchemaError(f"{f.name} is a number")
        return float(v)
    bits = {"INT8": 8, "INT16": 16, "INT32": 32, "INT64": 64}.get(f.type)
    if bits and (isinstance(v, bool) or not isinstance(v, int) or not -(1 << (bits - 1)) <= v < 1 << (bits - 1)):
        raise SchemaError(f"{f.name} is an integer of {bits} bits")
    if f.type in ("VARCHAR", "GEOMETRY") and not isinstance(v, str):
        raise SchemaError(f"{f.name} is text")
    if f.type == "BOOL" and not isinstance(v, bool):
        raise SchemaError(f"{f.name} is a boolean")
    return v
