"""Values of JSON text whose type is known at run time only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|INT|SMALLINT|TINYINT)$"


def path_text(keys: list[str | int]) -> str:
    """A variant path of object keys and array indices."""
    out = "$"
    for k in keys:
        out += f"[{k}]" if isinstance(k, int) else "['" + k.replace("\\", "\\\\").replace("'", "\\'") + "']"
    return out


@dataclass(frozen=True)
class Dynamic:
    """A variant column and its parts by type; each part is null where the value has another type."""

    value: Column
    source: Column | None = None
    path: str = "$"

    @property
    def kind(self) -> Column:
        return F.schema_of_variant(self.value)

    def at(self, keys: list[str | int]) -> Dynamic:
        return Dynamic(F.try_variant_get(self.value, path_text(keys), "variant"), self.value, path_text(keys))

    def cast(self, kind: str) -> Column:
        """The value as ``kind``, in one step from the text; other types are converted, too."""
        return F.try_variant_get(self.value if self.source is None else self.source, self.path, kind)

    @property
    def number(self) -> Column:
        return F.when(self.kind.rlike(NUMERIC), F.try_variant_get(self.value, "$", "double"))

    @property
    def string(self) -> Column:
        return F.when(self.kind == "STRING", F.try_variant_get(self.value, "$", "string"))

    @property
    def boolean(self) -> Column:
        return F.when(self.kind == "BOOLEAN", F.try_variant_get(self.value, "$", "boolean"))

    @property
    def items(self) -> Column:
        return F.when(self.kind.startswith("ARRAY"), F.try_variant_get(self.value, "$", "array<variant>"))

    @property
    def missing(self) -> Column:
        """No such key, JSON null, or text that isn't JSON."""
        return F.coalesce(F.is_variant_null(self.value), F.lit(True)) | self.value.isNull()


def parsed(text: Column) -> Dynamic:
    return Dynamic(F.try_parse_json(text))
