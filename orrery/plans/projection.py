"""Output columns of queries and searches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions import temporal, variants
from orrery.schema import META, CollectionSpec


def output_columns(spec: CollectionSpec, fields: list[str] | None, search: bool = False) -> list[Column]:
    """The columns for ``fields``.

    None and ``*``: all fields and the dynamic JSON; an empty list: none but the key; a name that no field has: that key of
    the dynamic JSON, as text; schema fields win over dynamic keys of the same name. A query always returns the primary
    field; a search returns it as ``id``.
    """
    pk = spec.primary.name
    out: dict[str, Column] = {} if search else {pk: F.col(f"`{pk}`")}
    names = ["*"] if fields is None else fields
    for n in names:
        if n == "*":
            for f in spec.fields:
                if not (search and f.primary):
                    out[f.name] = F.col(f"`{f.name}`")
            if spec.dynamic:
                out[META] = F.col(f"`{META}`")
        elif n in spec:
            if not (search and n == pk):
                out[n] = F.col(f"`{n}`")
        elif n == META and spec.dynamic:
            out[META] = F.col(f"`{META}`")
        elif spec.dynamic:
            out[n] = F.try_variant_get(F.try_parse_json(F.col(f"`{META}`")), variants.path_text([n]), "string")
        else:
            spec[n]  # raises
    return [c.alias(n) for n, c in out.items()]


def with_time(spec: CollectionSpec, columns: list[str], parts: list[str] | None = None, timezone: str = "UTC") -> list[Column]:
    """TIMESTAMPTZ columns as ISO text, or as arrays of ``parts`` in a zone; all others as they are."""
    out = []
    for c in columns:
        if c in spec and spec[c].type == "TIMESTAMPTZ":
            col = F.col(f"`{c}`")
            out.append((temporal.time_fields(col, parts, timezone) if parts else temporal.iso_text(col)).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return out
