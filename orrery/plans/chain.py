"""Rerank chains: a fluent builder over (qid, id, score, ...) hits, and the public form of a chain as a checked spec."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.errors import QueryError
from orrery.functions import metrics, temporal
from orrery.operators import fusion
from orrery.operators.knn import top_k

#: Names of the public form for what the hits call id and score.
ALIASES = {"$id": "id", "$score": "score"}


def column(name: str) -> str:
    return ALIASES.get(name, name)


@dataclass
class Chain:
    """Steps over hits, each from DataFrame to DataFrame; nothing runs until the result does."""

    steps: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)

    def _then(self, step: Callable[[DataFrame], DataFrame]) -> Chain:
        return Chain([*self.steps, step])

    def map(self, output: str, expr: Callable[..., Column], *inputs: str | float) -> Chain:
        """A new or replaced column from columns and literals."""
        args = [F.col(column(i)) if isinstance(i, str) else F.lit(i) for i in inputs]
        return self._then(lambda df: df.withColumn(column(output), expr(*args)))

    def sort(self, by: str = "$score", descending: bool = True) -> Chain:
        return self._then(lambda df: _ranked(df, fusion.sort_key(column(by), descending)))

    def limit(self, n: int, offset: int = 0) -> Chain:
        """Per query ``n`` hits after ``offset``, in the order of the last sort (by score if there was none)."""
        if n < 1 or offset < 0:
            raise QueryError("limit is at least 1 and offset at least 0")

        def step(df: DataFrame) -> DataFrame:
            df = df if "rank" in df.columns else _ranked(df, fusion.sort_key("score"))
            return df.where((F.col("rank") > offset) & (F.col("rank") <= offset + n)).withColumn("rank", F.col("rank") - offset)

        return self._then(step)

    def select(self, *names: str) -> Chain:
        return self._then(lambda df: df.select("qid", *[column(n) for n in names if column(n) != "qid"]))

    def group_by(self, group: str, limit: int, size: int = 1, scorer: str = "max", offset: int = 0) -> Chain:
        return self._then(lambda df: fusion.group_hits(df, group, limit, size, scorer, offset))

    def execute(self, hits: DataFrame) -> DataFrame:
        for s in self.steps:
            hits = s(hits)
        return hits


def _ranked(df: DataFrame, by: list[Column]) -> DataFrame:
    return top_k(df.drop("rank"), by, 16_384)


def _number(params: dict, name: str, default: Any = None) -> float:
    v = params.get(name, default)
    if isinstance(v, bool) or not isinstance(v, int | float):
        raise QueryError(f"{name} is a number")
    return float(v)


def expression(name: str, params: dict[str, Any], timestamps: set[str] = frozenset(), inputs: list[str] = ()) -> Callable[..., Column]:
    """The function expression ``name``: decay, num_combine (or score_combine), round_decimal, or rerank_model (with a provider's column function)."""
    if name == "decay":
        unknown = set(params) - {"function", "origin", "scale", "offset", "decay"}
        if unknown:
            raise QueryError(f"decay has no parameter {sorted(unknown)[0]}")
        args = (params.get("function"), _number(params, "origin"), _number(params, "scale"), _number(params, "offset", 0.0), _number(params, "decay", 0.5))
        timed = bool(inputs) and inputs[0] in timestamps
        fusion.decay(F.lit(0.0), *args)
        return lambda c: fusion.decay(temporal.epoch_seconds(c) if timed else c, *args)
    if name in ("num_combine", "score_combine"):
        mode, weights = params.get("mode", "sum"), params.get("weights")
        fusion.num_combine([F.lit(0.0)] * max(2, len(inputs)), mode, weights)
        return lambda *c: fusion.num_combine(list(c), mode, weights)
    if name == "round_decimal":
        digits = params.get("decimal")
        if isinstance(digits, bool) or not isinstance(digits, int):
            raise QueryError("round_decimal needs a number of digits")
        fusion.round_decimal(F.lit(0.0), digits)
        return lambda c: fusion.round_decimal(c, digits)
    if name == "rerank_model":
        provider = params.get("provider")
        if not callable(provider):
            raise QueryError("rerank_model needs a provider")
        return provider
    raise QueryError(f"unknown expression {name!r}")


def from_spec(spec: list[dict[str, Any]], columns: list[str], timestamps: set[str] = frozenset()) -> Chain:
    """The chain of a public spec: a list of {"op": "map" | "sort" | "limit", ...}, checked against the ``columns`` of the hits.

    map: {"expr", "params", "inputs", "output"}; sort: {"by", "order"}; limit: {"limit", "offset"}. At most one limit, and nothing
    but rounding after it.
    """
    if not spec:
        raise QueryError("a chain has one step at least")
    known = {*columns, "$id", "$score", "id", "score"}
    chain, limited = Chain(), False
    for s in spec:
        op = s.get("op")
        if op == "map":
            inputs = s.get("inputs") or []
            for i in inputs:
                if isinstance(i, str) and i not in known:
                    raise QueryError(f"the hits have no column {i!r}")
            out = s.get("output")
            if not out or out == "$id":
                raise QueryError("map needs an output that isn't $id")
            if limited and s.get("expr") != "round_decimal":
                raise QueryError("only rounding can follow a limit")
            chain = chain.map(out, expression(s.get("expr"), s.get("params") or {}, timestamps, [i for i in inputs if isinstance(i, str)]), *inputs)
            known.add(out)
        elif op == "sort":
            if s.get("by") not in known or s.get("order", "desc") not in ("asc", "desc"):
                raise QueryError("sort needs a known column and asc or desc")
            chain = chain.sort(s["by"], s.get("order", "desc") == "desc")
        elif op == "limit":
            if limited or not isinstance(s.get("limit"), int):
                raise QueryError("a chain has one limit, a number")
            chain, limited = chain.limit(s["limit"], s.get("offset", 0)), True
        else:
            raise QueryError(f"unknown step {op!r}")
    return chain


def hybrid(routes: list[tuple[DataFrame, str]], how: str, limit: int, *, offset: int = 0, decay_of: str | None = None, decay_params: dict | None = None, group: str | None = None, group_size: int = 1, digits: int | None = None, **merge_args: Any) -> DataFrame:
    """Fusion of routes, then an optional decay factor, then groups or the best ``limit``, then rounding."""
    ascending = fusion.merged_ascending([m for _, m in routes], how, merge_args.get("force_descending", False))
    if decay_of is not None:
        merge_args["force_descending"], ascending = True, False
    hits = fusion.merge(routes, how, **merge_args)
    if decay_of is not None:
        hits = hits.withColumn("score", F.col("score") * expression("decay", decay_params or {})(F.col(decay_of)))
    if group is not None:
        hits = fusion.group_hits(hits, group, limit, group_size, offset=offset, ascending=ascending)
    else:
        hits = top_k(hits, fusion.sort_key("score", not ascending), limit, offset)
    return hits.withColumn("score", fusion.round_decimal(F.col("score"), digits)) if digits is not None else hits


__all__ = ["Chain", "expression", "from_spec", "hybrid", "metrics"]
