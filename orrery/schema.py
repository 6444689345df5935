"""Collection schemas: fields, functions, rules, and checks of records as Spark expressions."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.errors import SchemaError
from orrery.functions import geometry

INTS = {"INT8": T.ByteType(), "INT16": T.ShortType(), "INT32": T.IntegerType(), "INT64": T.LongType()}
SCALARS: dict[str, T.DataType] = {"BOOL": T.BooleanType(), **INTS, "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "VARCHAR": T.StringType()}
TYPES: dict[str, T.DataType] = {
    **SCALARS,
    "JSON": T.StringType(),
    "GEOMETRY": T.StringType(),
    "TIMESTAMPTZ": T.TimestampType(),
    "FLOAT_VECTOR": T.ArrayType(T.FloatType()),
    "SPARSE_FLOAT_VECTOR": T.MapType(T.LongType(), T.FloatType()),
}
RESERVED = ("_seq", "_partition", "_op", "$meta")
RESERVED_ANY_CASE = ("iso", "interval")
VECTORS = ("FLOAT_VECTOR", "SPARSE_FLOAT_VECTOR")
META = "$meta"


@dataclass(frozen=True)
class FieldSpec:
    """One field. ``type`` is a key of TYPES or ARRAY (then ``element`` is one of SCALARS)."""

    name: str
    type: str
    primary: bool = False
    auto_id: bool = False
    nullable: bool = False
    default: Any = None
    dim: int | None = None
    max_length: int | None = None
    element: str | None = None
    max_capacity: int | None = None
    partition_key: bool = False
    analyzer: dict | None = None

    def spark_type(self) -> T.DataType:
        return T.ArrayType(SCALARS[self.element]) if self.type == "ARRAY" else TYPES[self.type]


@dataclass(frozen=True)
class FunctionSpec:
    """BM25 (text to terms) or TEXT_EMBEDDING (text to vector), applied when rows are written."""

    name: str
    type: str
    input: str
    output: str
    params: dict = field(default_factory=dict)


@dataclass(frozen=True)
class CollectionSpec:
    """The fixed schema of a collection."""

    fields: tuple[FieldSpec, ...]
    functions: tuple[FunctionSpec, ...] = ()
    dynamic: bool = False
    description: str = ""

    def __post_init__(self) -> None:
        for part in ("fields", "functions"):
            object.__setattr__(self, part, tuple(getattr(self, part)))
        names = [f.name for f in self.fields]
        _need(len(set(names)) == len(names), "field names repeat")
        for f in self.fields:
            _check_field(f)
        keys = [f for f in self.fields if f.primary]
        _need(len(keys) == 1, "a schema has exactly one primary field")
        _need(keys[0].type in ("INT64", "VARCHAR") and not keys[0].nullable, "the primary field is a non-null INT64 or VARCHAR")
        _need(not keys[0].auto_id or keys[0].type == "INT64", "only an INT64 primary field can number itself")
        _need(not any(f.auto_id and not f.primary for f in self.fields), "only the primary field can number itself")
        _need(any(f.type in VECTORS for f in self.fields), "a schema has a vector field at least")
        parts = [f for f in self.fields if f.partition_key]
        _need(len(parts) <= 1 and all(f.type in ("INT64", "VARCHAR") and not f.primary for f in parts), "at most one INT64 or VARCHAR field besides the primary is the partition key")
        for f in self.functions:
            self._check_function(f)
        for what in ("name", "output"):
            x = [getattr(f, what) for f in self.functions]
            _need(len(set(x)) == len(x), f"function {what}s repeat")

    def _check_function(self, f: FunctionSpec) -> None:
        _need(f.type in ("BM25", "TEXT_EMBEDDING"), f"a schema can't have a function of type {f.type}")
        _need(f.input in self and self[f.input].type == "VARCHAR", f"{f.name}: the input is a VARCHAR field")
        want = "SPARSE_FLOAT_VECTOR" if f.type == "BM25" else "FLOAT_VECTOR"
        _need(f.output in self and self[f.output].type == want, f"{f.name}: the output is a {want} field")
        _need(f.type != "BM25" or self[f.input].analyzer is not None, f"{f.name}: the input needs an analyzer")

    def __contains__(self, name: str) -> bool:
        return any(f.name == name for f in self.fields)

    def __getitem__(self, name: str) -> FieldSpec:
        for f in self.fields:
            if f.name == name:
                return f
        raise SchemaError(f"no field is called {name!r}")

    @property
    def primary(self) -> FieldSpec:
        return next(f for f in self.fields if f.primary)

    @property
    def partition_key(self) -> FieldSpec | None:
        return next((f for f in self.fields if f.partition_key), None)

    @property
    def outputs(self) -> set[str]:
        return {f.output for f in self.functions}

    def struct(self, hidden: bool = False) -> T.StructType:
        """The Spark schema; ``hidden`` adds the columns of the mutation log."""
        fields = [T.StructField(f.name, f.spark_type(), True, {k: v for k, v in (("dim", f.dim), ("primary", f.primary or None), ("max_length", f.max_length)) if v is not None}) for f in self.fields]
        if self.dynamic:
            fields.append(T.StructField(META, T.StringType()))
        if hidden:
            fields += [T.StructField("_seq", T.LongType()), T.StructField("_partition", T.StringType())]
        return T.StructType(fields)

    def to_json(self) -> str:
        return json.dumps({"fields": [asdict(f) for f in self.fields], "functions": [asdict(f) for f in self.functions], "dynamic": self.dynamic, "description": self.description})

    @staticmethod
    def from_json(text: str) -> CollectionSpec:
        d = json.loads(text)
        return CollectionSpec(tuple(FieldSpec(**f) for f in d["fields"]), tuple(FunctionSpec(**f) for f in d["functions"]), d["dynamic"], d["description"])


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise SchemaError(message)


def _check_field(f: FieldSpec) -> None:
    _need(bool(f.name) and f.name not in RESERVED and f.name.lower() not in RESERVED_ANY_CASE, f"{f.name!r} can't be a field name")
    _need(f.type in TYPES or f.type == "ARRAY", f"{f.name}: unknown type {f.type}")
    _need(f.type != "ARRAY" or f.element in SCALARS, f"{f.name}: an ARRAY needs a scalar element type")
    _need(f.type != "FLOAT_VECTOR" or (f.dim or 0) > 0, f"{f.name}: a vector needs a positive dim")
    _need(f.max_length is None or f.max_length > 0, f"{f.name}: max_length is positive")


def problem(spec: CollectionSpec) -> Column:
    """For a row of the schema's columns the first rule that it breaks, or null."""
    tests: list[tuple[Column, str]] = []
    for f in spec.fields:
        c = F.col(f"`{f.name}`")
        if f.name not in spec.outputs and not f.nullable and not f.auto_id:
            tests.append((c.isNull(), f"{f.name} is null"))
        if f.max_length is not None and f.type == "VARCHAR":
            tests.append((F.length(c) > f.max_length, f"{f.name} is longer than {f.max_length}"))
        if f.type == "ARRAY" and f.max_capacity is not None:
            tests.append((F.size(c) > f.max_capacity, f"{f.name} has more than {f.max_capacity} elements"))
        if f.type == "FLOAT_VECTOR":
            tests.append((F.size(c) != f.dim, f"{f.name} has not {f.dim} components"))
            tests.append((F.exists(c, lambda x: x.isNull()), f"{f.name} has a null component"))
        if f.type == "SPARSE_FLOAT_VECTOR":
            tests.append((F.exists(F.map_keys(c), lambda k: (k < 0) | (k >= 1 << 32)), f"{f.name} has an index beyond 32 bits"))
        if f.type == "GEOMETRY":
            tests.append((c.isNotNull() & ~geometry.is_valid(c), f"{f.name} is no supported WKT"))
    out = F.lit(None).cast("string")
    for bad, text in reversed(tests):
        out = F.when(F.coalesce(bad, F.lit(False)), F.lit(text)).otherwise(out)
    return out


def conform(rows: DataFrame, spec: CollectionSpec) -> DataFrame:
    """``rows`` in the schema's columns and types: defaults filled, unknown columns packed into the dynamic JSON.

    JSON fields take text as it is and anything else as its JSON. Columns that no field has are an error unless the schema
    is dynamic; in the packed text keys are sorted and nulls left out.
    """
    have = {c: rows.schema[c].dataType for c in rows.columns}
    extra = sorted(c for c in have if c not in spec and c != META)
    _need(spec.dynamic or not extra, f"unknown fields {', '.join(extra)}")
    cols = []
    for f in spec.fields:
        if f.name in spec.outputs:
            _need(f.name not in have, f"{f.name} is made by a function")
            c = F.lit(None)
        elif f.name not in have:
            _need(f.nullable or f.default is not None or f.auto_id, f"{f.name} is missing")
            c = F.lit(f.default)
        else:
            c = F.col(f"`{f.name}`")
            if f.type == "JSON" and not isinstance(have[f.name], T.StringType):
                c = F.to_json(c) if isinstance(have[f.name], (T.StructType, T.ArrayType, T.MapType)) else c.cast("string")
            if f.default is not None:
                c = F.coalesce(c, F.lit(f.default))
        cols.append(c.cast(f.spark_type()).alias(f.name))
    if spec.dynamic:
        packed = F.to_json(F.struct(*[F.col(f"`{c}`") for c in extra])) if extra else F.lit(None).cast("string")
        cols.append((F.coalesce(packed, F.col(f"`{META}`")) if META in have else packed).alias(META))
    return rows.select(*cols)
