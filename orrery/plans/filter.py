"""The filter language: text to a boolean Spark column.

Precedence from loose to tight: ``or ||``, ``and &&``, ``not !``, comparisons with ``in``, ``like`` and ``is null``,
``+ -``, ``* /``, unary minus and ``exists``. A column of the result is never null: what is unknown is False.

Null rules depend on the whole expression. In the columnar mode a null is not ``in`` any list, so ``not in`` is True for it, and
division follows IEEE; an expression that contains a path access, an array function, geometry or ``text_match`` is in row mode,
where membership of a null is unknown and a division by zero is null.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from typing import Any, NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.errors import FilterError, FilterFieldError, FilterParseError, FilterTypeError, SchemaError
from orrery.functions import geometry, temporal, text, variants
from orrery.schema import META, CollectionSpec

# -- words

_LEX = re.compile(
    r"""\s*(?:
      (?P<float>(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)
    | (?P<int>\d+)
    | (?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
    | (?P<name>\$?[A-Za-z_][A-Za-z0-9_]*)
    | (?P<op>==|!=|<=|>=|&&|\|\||[<>+\-*/!()\[\],])
    )""",
    re.VERBOSE | re.DOTALL,
)
_HINTS = {"=": "use '==' to compare", "<>": "use '!=' to compare", "&": "use '&&' or 'and'", "|": "use '||' or 'or'"}
_ESCAPES = dict(zip("\"'\\nrt", "\"'\\\n\r\t"))
_WORDS = {"and", "or", "not", "in", "like", "is", "null", "exists"}
_BOOLS = {"true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}


class Token(NamedTuple):
    kind: str  # int, float, str, name, op, word, bool, end
    value: Any
    at: int


def tokenize(source: str) -> list[Token]:
    out, at = [], 0
    while source[at:].strip():
        m = _LEX.match(source, at)
        at += len(source[at:]) - len(source[at:].lstrip())
        if m is None:
            for bad in ("<>", "=", "&", "|"):
                if source.startswith(bad, at):
                    raise FilterParseError(f"unexpected {bad!r}; {_HINTS[bad]}", source, at)
            what = "a string without an end" if source[at] in "\"'" else f"unexpected {source[at]!r}"
            raise FilterParseError(what, source, at)
        kind, raw = m.lastgroup, m.group(m.lastgroup)
        if kind == "op" and raw == "<" and source.startswith("<>", at):
            raise FilterParseError(f"unexpected '<>'; {_HINTS['<>']}", source, at)
        value: Any = raw
        if kind == "int":
            value = int(raw)
        elif kind == "float":
            value = float(raw)
        elif kind == "str":
            value = _unescape(raw[1:-1], source, at)
        elif kind == "name" and raw in _BOOLS:
            kind, value = "bool", _BOOLS[raw]
        elif kind == "name" and raw.lower() in _WORDS:
            kind, value = "word", raw.lower()
        elif kind == "op":
            kind, value = {"&&": ("word", "and"), "||": ("word", "or"), "!": ("word", "not")}.get(raw, ("op", raw))
        out.append(Token(kind, value, at))
        at = m.end()
    return [*out, Token("end", None, len(source))]


def _unescape(body: str, source: str, at: int) -> str:
    def one(m: re.Match) -> str:
        if m[1] not in _ESCAPES:
            raise FilterParseError(f"unknown escape \\{m[1]}", source, at + 1 + m.start())
        return _ESCAPES[m[1]]

    return re.sub(r"\\(.)", one, body, flags=re.DOTALL)


# -- trees


@dataclass(frozen=True)
class Node:
    """``op`` with its operands: nodes, literals or names."""

    op: str
    args: tuple
    at: int


_COMPARE = tuple("== != < <= > >=".split())
_ARRAY = {f"{p}_contains{s}": (p, s.strip("_")) for p in ("array", "json") for s in ("", "_all", "_any")}
_GEO = {f"{p}{s}": s for p in ("st_", "geometry_") for s in ("contains", "within", "intersects")}


class _Parser:
    def __init__(self, source: str, timezone: str | None):
        self.source, self.timezone = source, timezone
        self.tokens, self.i = tokenize(source), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def fail(self, message: str, at: int | None = None) -> FilterParseError:
        return FilterParseError(message, self.source, self.now.at if at is None else at)

    def take(self, kind: str, *values: Any) -> Token | None:
        t = self.now
        if t.kind == kind and (not values or t.value in values):
            self.i += 1
            return t
        return None

    def need(self, kind: str, value: Any = None, what: str = "") -> Token:
        t = self.take(kind, *([value] if value is not None else []))
        if t is None:
            raise self.fail(f"expected {what or value or kind}" + (" before the end" if self.now.kind == "end" else f", not {self.now.value!r}"))
        return t

    def parse(self) -> Node:
        if self.now.kind == "end":
            raise self.fail("the expression is empty")
        n = self.disjunction()
        if self.now.kind != "end":
            raise self.fail(f"unexpected {self.now.value!r}")
        return n

    def chain(self, word: str, below: Callable[[], Node]) -> Node:
        first = below()
        parts = [first]
        while self.take("word", word):
            parts.append(below())
        return Node(word, tuple(parts), first.at) if len(parts) > 1 else first

    def disjunction(self) -> Node:
        return self.chain("or", lambda: self.chain("and", self.negation))

    def negation(self) -> Node:
        if t := self.take("word", "not"):
            return Node("not", (self.negation(),), t.at)
        return self.comparison()

    def comparison(self) -> Node:
        left = self.sum()
        while True:
            if t := self.take("op", *_COMPARE):
                left = Node("cmp", (t.value, left, self.sum()), t.at)
            elif t := self.take("word", "like"):
                left = Node("like", (left, self.need("str", what="a pattern").value), t.at)
            elif t := self.take("word", "is"):
                negated = bool(self.take("word", "not"))
                self.need("word", "null")
                if left.op not in ("field", "path", "meta"):
                    raise self.fail("'is null' needs a field", t.at)
                left = Node("null", (left, negated, False), t.at)
            elif self.now.kind == "word" and (self.now.value == "in" or (self.now.value == "not" and self.tokens[self.i + 1][:2] == ("word", "in"))):
                t = self.now
                negated = bool(self.take("word", "not"))
                self.need("word", "in")
                if left.op not in ("field", "path", "meta"):
                    raise self.fail("'in' needs a field on its left", t.at)
                left = Node("in", (left, self.literals(), negated), t.at)
            else:
                return left

    def sum(self) -> Node:
        left = self.product()
        while t := self.take("op", "+", "-"):
            left = Node("arith", (t.value, left, self.product()), t.at)
        return left

    def product(self) -> Node:
        left = self.unary()
        while t := self.take("op", "*", "/"):
            left = Node("arith", (t.value, left, self.unary()), t.at)
        return left

    def unary(self) -> Node:
        if t := self.take("op", "-"):
            inner = self.unary()
            if inner.op == "lit" and inner.args[0] in ("int", "float"):
                return Node("lit", (inner.args[0], -inner.args[1]), t.at)
            return Node("arith", ("-", Node("lit", ("int", 0), t.at), inner), t.at)
        if t := self.take("word", "exists"):
            inner = self.primary()
            if inner.op not in ("field", "path", "meta"):
                raise self.fail("'exists' needs a field or a key", t.at)
            return Node("null", (inner, True, True), t.at)
        return self.primary()

    def literal(self) -> Node:
        sign = self.take("op", "-")
        for kind in ("int", "float") if sign else ("int", "float", "str", "bool"):
            if t := self.take(kind):
                return Node("lit", (kind, -t.value if sign else t.value), t.at)
        if not sign and self.now.kind == "name" and self.now.value.lower() == "iso":
            return self.primary()
        raise self.fail("expected a literal")

    def literals(self) -> tuple[Node, ...]:
        self.need("op", "[")
        out = []
        while not self.take("op", "]"):
            if out:
                self.need("op", ",")
            out.append(self.literal())
        return tuple(out)

    def keys(self, base: Node) -> Node:
        found: list[str | int] = []
        while self.now.kind == "op" and self.now.value == "[":
            self.need("op", "[")
            if t := self.take("str"):
                found.append(t.value)
            elif t := self.take("int"):
                found.append(t.value)
            else:
                raise self.fail("expected a key or an index that isn't negative")
            self.need("op", "]")
        return Node("path", (base, tuple(found)), base.at) if found else base

    def primary(self) -> Node:
        t = self.now
        if self.take("op", "("):
            n = self.disjunction()
            self.need("op", ")")
            return n
        for kind in ("int", "float", "str", "bool"):
            if self.take(kind):
                return Node("lit", (kind, t.value), t.at)
        if not self.take("name"):
            raise self.fail("expected a value" + (" before the end" if t.kind == "end" else f", not {t.value!r}"))
        low = t.value.lower()
        if low in ("iso", "interval") and self.now.kind == "str":
            raw = self.need("str")
            try:
                if low == "iso":
                    return Node("lit", ("time", temporal.parse_timestamp(raw.value, self.timezone)), t.at)
                return Node("lit", ("interval", temporal.parse_interval(raw.value)), t.at)
            except SchemaError as e:
                raise self.fail(str(e), raw.at) from e
        if t.value == META:
            self.need("op", "[")
            key = self.need("str", what="a key")
            self.need("op", "]")
            return self.keys(Node("meta", (key.value,), t.at))
        if t.value.startswith("$"):
            raise self.fail(f"unknown name {t.value}", t.at)
        if self.take("op", "("):
            return self.call(low, t)
        return self.keys(Node("field", (t.value,), t.at))

    def call(self, name: str, t: Token) -> Node:
        def field() -> Node:
            n = self.primary()
            if n.op not in ("field", "path", "meta"):
                raise self.fail(f"{t.value} needs a field", n.at)
            return n

        def then(kind: str) -> Any:
            self.need("op", ",")
            return self.need(kind).value

        if name == "text_match":
            n = Node("text_match", (field(), then("str")), t.at)
        elif name in _ARRAY:
            mode = _ARRAY[name][1].removeprefix("contains_") if _ARRAY[name][1] else "one"
            what = field()
            self.need("op", ",")
            n = Node("contains", (what, self.literals() if mode != "one" else (self.literal(),), mode), t.at)
        elif name == "array_length":
            n = Node("length", (field(),), t.at)
            if n.args[0].op == "path":
                raise self.fail("array_length takes a plain field", n.args[0].at)
        elif name in _GEO:
            n = Node("geo", (_GEO[name], field(), then("str"), None), t.at)
        elif name in ("st_isvalid", "geometry_isvalid"):
            n = Node("geo_valid", (field(),), t.at)
        elif name in ("st_dwithin", "geometry_dwithin"):
            where, shape = field(), then("str")
            self.need("op", ",")
            d = self.take("int") or self.take("float")
            if d is None:
                raise self.fail("the distance is a number that isn't negative")
            n = Node("geo", ("dwithin", where, shape, float(d.value)), t.at)
        else:
            raise self.fail(f"unknown function {t.value!r}", t.at)
        self.need("op", ")")
        return n


@lru_cache(maxsize=256)
def parse(source: str, timezone: str | None = None) -> Node:
    """The tree of an expression. Naive ISO literals are in ``timezone``."""
    return _Parser(source, timezone).parse()


# -- columns

_SEMANTIC = {"BOOL": "bool", "INT8": "int", "INT16": "int", "INT32": "int", "INT64": "int", "FLOAT": "float", "DOUBLE": "float", "VARCHAR": "str", "JSON": "str", "TIMESTAMPTZ": "time", "ARRAY": "dyn", "GEOMETRY": "geo"}
_NUMBERS = ("int", "float")
_ROW_OPS = ("path", "contains", "length", "geo", "geo_valid", "text_match")


class Typed(NamedTuple):
    kind: str  # bool, int, float, str, time, interval, geo, dyn (a Dynamic), array (column of a typed array)
    col: Any


def _walk(n: Any) -> list[Node]:
    out = []
    if isinstance(n, Node):
        out.append(n)
        for a in n.args:
            for x in a if isinstance(a, tuple) else (a,):
                out += _walk(x)
    return out


class _Compiler:
    def __init__(self, source: str, spec: CollectionSpec, row_mode: bool, positive: bool = False):
        """``positive``: unknown may stay unknown, as a filter drops it; tests then keep a form that reaches the Parquet scan."""
        self.source, self.spec, self.row_mode, self.positive = source, spec, row_mode, positive

    def bad_type(self, message: str, n: Node) -> FilterTypeError:
        return FilterTypeError(message, self.source, n.at)

    # -- values

    def value(self, n: Node) -> Typed:
        if n.op == "lit":
            return Typed(n.args[0], F.lit(n.args[1]))
        if n.op == "field":
            return self.field(n)
        if n.op == "meta":
            return Typed("dyn", self.meta(n).at([n.args[0]]))
        if n.op == "path":
            return Typed("dyn", self.path(n)) if not self.is_array(n.args[0]) else self.element(n)
        if n.op == "arith":
            return self.arith(n)
        if n.op == "length":
            return Typed("int", self.length(n))
        return Typed("bool", self.test(n))

    def meta(self, n: Node) -> variants.Dynamic:
        if not self.spec.dynamic:
            raise FilterFieldError("the schema has no dynamic fields", self.source, n.at)
        return variants.parsed(F.col(f"`{META}`"))

    def field(self, n: Node) -> Typed:
        name = n.args[0]
        if name in ("_seq", "_partition", "_op"):
            raise FilterFieldError(f"{name} is reserved", self.source, n.at)
        if name not in self.spec:
            if self.spec.dynamic:
                return Typed("dyn", self.meta(n).at([name]))
            raise FilterFieldError(f"no field is called {name!r}; there are {', '.join(f.name for f in self.spec.fields)}", self.source, n.at)
        f = self.spec[name]
        if f.type not in _SEMANTIC:
            raise self.bad_type(f"{name} is a {f.type}, which a filter can't use", n)
        return Typed("array" if f.type == "ARRAY" else _SEMANTIC[f.type], F.col(f"`{name}`"))

    def is_array(self, n: Node) -> bool:
        return n.op == "field" and n.args[0] in self.spec and self.spec[n.args[0]].type == "ARRAY"

    def element(self, n: Node) -> Typed:
        base, keys = n.args
        f = self.spec[base.args[0]]
        kind = _SEMANTIC[f.element]
        if len(keys) != 1 or not isinstance(keys[0], int):
            return Typed(kind, F.lit(None).cast(f.spark_type().elementType))
        return Typed(kind, F.try_element_at(F.col(f"`{f.name}`"), F.lit(keys[0] + 1)))

    def path(self, n: Node) -> variants.Dynamic:
        base, keys = n.args
        if base.op == "meta":
            return self.meta(base).at([base.args[0], *keys])
        b = self.field(base)
        if b.kind == "dyn":
            return self.meta(base).at([base.args[0], *keys])
        if b.kind != "str":
            raise self.bad_type(f"{base.args[0]} has no keys", n)
        return variants.parsed(b.col).at(list(keys))

    def arith(self, n: Node) -> Typed:
        op, a, b = n.args[0], self.value(n.args[1]), self.value(n.args[2])
        if (a.kind, b.kind) == ("time", "interval") and op in "+-":
            return Typed("time", a.col + b.col if op == "+" else a.col - b.col)
        if (a.kind, b.kind) == ("interval", "time") and op == "+":
            return Typed("time", b.col + a.col)
        for x, side in ((a, n.args[1]), (b, n.args[2])):
            if x.kind not in (*_NUMBERS, "dyn"):
                raise self.bad_type(f"'{op}' needs numbers, not {x.kind}", side)
        dynamic = "dyn" in (a.kind, b.kind)
        x, y = (v.col.number if v.kind == "dyn" else v.col for v in (a, b))
        if op == "/":
            x, y = x.cast("double"), y.cast("double")
            if self.row_mode or dynamic:
                return Typed("float", F.try_divide(x, y))
            zero = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).otherwise(F.lit(None).cast("double"))
            return Typed("float", F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when(y == 0, zero).otherwise(F.try_divide(x, y)))
        if a.kind == b.kind == "int":
            f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op]
            return Typed("int", f(x.cast("long"), y.cast("long")))
        x, y = x.cast("double"), y.cast("double")
        return Typed("float", {"+": x + y, "-": x - y, "*": x * y}[op])

    # -- tests (three-valued)

    def test(self, n: Node) -> Column:
        if n.op in ("and", "or"):
            parts = []
            for x in n.args:
                parts.append(self.boolean(x, n.op))
            out = parts[0]
            for p in parts[1:]:
                out = out & p if n.op == "and" else out | p
            return out
        if n.op == "not":
            before, self.positive = self.positive, False
            out = ~self.boolean(n.args[0], "not")
            self.positive = before
            return out
        if n.op in ("field", "meta", "path", "lit"):
            v = self.value(n)
            if v.kind == "bool":
                return v.col
            if v.kind == "dyn":
                return v.col.boolean
            raise self.bad_type(f"a condition is needed, not {v.kind}", n)
        return getattr(self, f"test_{n.op}")(n)

    def boolean(self, n: Node, op: str) -> Column:
        if n.op in ("arith", "length") or (n.op == "lit" and n.args[0] != "bool"):
            raise self.bad_type(f"'{op}' needs conditions", n)
        return self.test(n)

    def test_cmp(self, n: Node) -> Column:
        op, a, b = n.args[0], self.value(n.args[1]), self.value(n.args[2])
        if "array" in (a.kind, b.kind) or "geo" in (a.kind, b.kind):
            raise self.bad_type(f"'{op}' can't compare {a.kind} and {b.kind}", n)
        if "dyn" in (a.kind, b.kind):
            return self.compare_dynamic(op, a, b)
        if a.kind != b.kind and not (a.kind in _NUMBERS and b.kind in _NUMBERS):
            raise self.bad_type(f"'{op}' can't compare {a.kind} and {b.kind}", n)
        x, y = a.col, b.col
        if a.kind in _NUMBERS and "float" in (a.kind, b.kind):
            x, y = x.cast("double"), y.cast("double")
            sides = [c for c, v, m in ((x, a, n.args[1]), (y, b, n.args[2])) if v.kind == "float" and m.op != "lit"]
            if self.positive:
                out = _compare(op, x, y)
                for c in sides:
                    out = out & ~F.isnan(c)
                return out
            x, y = (F.when(~F.isnan(c), c) for c in (x, y))
        return _compare(op, x, y)

    def compare_dynamic(self, op: str, a: Typed, b: Typed) -> Column:
        """By the type found at run time: other types are unequal, and their order is unknown."""
        if self.positive and op != "!=" and (a.kind == "dyn") != (b.kind == "dyn"):
            # only what is true counts: values are converted first, and the type is looked at where that compares as wanted
            v, other = (a, b) if a.kind == "dyn" else (b, a)
            kind, named = ("double", v.col.kind.rlike(variants.NUMERIC)) if other.kind in _NUMBERS else ("string", v.col.kind == "STRING") if other.kind == "str" else ("boolean", v.col.kind == "BOOLEAN") if other.kind == "bool" else (None, None)
            if kind:
                x, y = v.col.cast(kind), other.col.cast(kind)
                return (_compare(op, x, y) if v is a else _compare(op, y, x)) & named

        def part(v: Typed, kind: str) -> Column | None:
            if v.kind == "dyn":
                return getattr(v.col, {"num": "number", "str": "string", "bool": "boolean"}[kind])
            mine = "num" if v.kind in _NUMBERS else v.kind
            return (v.col.cast("double") if kind == "num" else v.col) if mine == kind else None

        absent = F.lit(False)
        for v in (a, b):
            absent = absent | (v.col.missing if v.kind == "dyn" else v.col.isNull())
        out = F.lit(None).cast("boolean") if op not in ("==", "!=") else F.lit(op == "!=")
        for kind in ("num", "str", "bool"):
            x, y = part(a, kind), part(b, kind)
            if x is not None and y is not None:
                out = F.when(x.isNotNull() & y.isNotNull(), _compare(op, x, y)).otherwise(out)
        return F.when(absent, F.lit(None).cast("boolean")).otherwise(out)

    def test_in(self, n: Node) -> Column:
        what, values, negated = n.args
        v = self.value(what)
        kinds = {x.args[0] for x in values}
        if len(kinds) > 1 and not kinds <= set(_NUMBERS):
            raise self.bad_type("the list mixes types", n)
        if v.kind in ("array", "geo"):
            raise self.bad_type(f"'in' can't search for {v.kind}", n)
        if v.kind != "dyn" and any(k != v.kind and not (k in _NUMBERS and v.kind in _NUMBERS) for k in kinds):
            raise self.bad_type(f"the list can't hold a {v.kind}", n)
        if not values:
            found = F.lit(False)
        elif v.kind == "dyn":
            part = v.col.number if kinds <= set(_NUMBERS) else v.col.string if kinds == {"str"} else v.col.boolean
            found = F.when(~v.col.missing, F.coalesce(part.isin([x.args[1] for x in values]), F.lit(False)))
        else:
            c = v.col.cast("double") if v.kind == "float" or "float" in kinds else v.col
            found = c.isin([x.args[1] for x in values])
        if not self.row_mode:
            found = found if self.positive and not negated else F.coalesce(found, F.lit(False))
        elif not values:
            absent = v.col.missing if v.kind == "dyn" else v.col.isNull()
            found = F.when(~absent, F.lit(False))
        return ~found if negated else found

    def test_like(self, n: Node) -> Column:
        v = self.value(n.args[0])
        if v.kind == "dyn":
            return F.when(~v.col.missing, F.coalesce(v.col.string.like(n.args[1]), F.lit(False)))
        if v.kind != "str":
            raise self.bad_type(f"'like' needs text, not {v.kind}", n)
        return v.col.like(n.args[1])

    def test_null(self, n: Node) -> Column:
        what, negated, exists = n.args
        if exists and what.op == "field" and what.args[0] in self.spec:
            raise self.bad_type("'exists' is for keys of JSON and dynamic fields", what)
        v = self.value(what)
        absent = v.col.missing if v.kind == "dyn" else v.col.isNull()
        return ~absent if negated else absent

    def test_text_match(self, n: Node) -> Column:
        v = self.value(n.args[0])
        if v.kind == "dyn":
            v = Typed("str", v.col.string)
        if v.kind != "str":
            raise self.bad_type("text_match needs text", n)
        words = sorted(set(text.python_tokens(n.args[1])))
        if not words:
            return F.lit(False)
        return F.coalesce(F.arrays_overlap(text.tokens(v.col), F.array(*map(F.lit, words))), F.lit(False))

    def items(self, n: Node) -> Typed:
        """The elements of an array field, or the variants of a JSON array."""
        if self.is_array(n):
            return Typed("array", F.col(f"`{n.args[0]}`"))
        v = self.value(n)
        if v.kind == "dyn":
            nested = variants.Dynamic(F.try_parse_json(v.col.string)).items
            return Typed("dyn", F.coalesce(v.col.items, nested))
        if v.kind == "str" and n.op == "field" and self.spec[n.args[0]].type == "JSON":
            return Typed("dyn", variants.parsed(v.col).items)
        raise self.bad_type("an array is needed", n)

    def test_contains(self, n: Node) -> Column:
        what, values, mode = n.args
        v = self.items(what)

        def has(x: Node) -> Column:
            kind, lit = x.args
            if v.kind == "array":
                mine = _SEMANTIC[self.spec[what.args[0]].element]
                if kind != mine and not (kind in _NUMBERS and mine in _NUMBERS):
                    return F.lit(False)
                return F.exists(v.col, lambda e: F.coalesce((e.cast("double") if mine in _NUMBERS else e) == F.lit(float(lit) if mine in _NUMBERS else lit), F.lit(False)))
            part = "number" if kind in _NUMBERS else "string" if kind == "str" else "boolean"
            want = F.lit(float(lit) if kind in _NUMBERS else lit)
            return F.exists(v.col, lambda e: F.coalesce(getattr(variants.Dynamic(e), part) == want, F.lit(False)))

        out = F.lit(mode != "any")
        for x in values:
            out = out | has(x) if mode == "any" else out & has(x)
        return F.coalesce(v.col.isNotNull() & out, F.lit(False))

    def length(self, n: Node) -> Column:
        v = self.items(n.args[0])
        return F.coalesce(F.when(v.col.isNotNull(), F.size(v.col)), F.lit(0)).cast("long")

    def shape(self, n: Node) -> Column:
        v = self.value(n)
        if v.kind != "geo":
            raise self.bad_type(f"a GEOMETRY field is needed, not {v.kind}", n)
        return v.col

    def test_geo(self, n: Node) -> Column:
        op, what, wkt, most = n.args
        col = self.shape(what)
        try:
            return F.coalesce(geometry.predicate(col, op, wkt, most), F.lit(False))
        except SchemaError as e:
            raise self.bad_type(str(e), n) from e

    def test_geo_valid(self, n: Node) -> Column:
        return geometry.is_valid(self.shape(n.args[0]))


def _compare(op: str, x: Column, y: Column) -> Column:
    return {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def to_column(source: str, spec: CollectionSpec, timezone: str | None = None) -> Column:
    """The condition ``source`` over the columns of ``spec``; never null."""
    return F.coalesce(_compiled(source, spec, timezone, positive=False), F.lit(False))


def predicate(source: str, spec: CollectionSpec, timezone: str | None = None) -> Column:
    """The same for ``DataFrame.where`` alone: null where the condition is unknown, and open to pushdown."""
    return _compiled(source, spec, timezone, positive=True)


def _compiled(source: str, spec: CollectionSpec, timezone: str | None, positive: bool) -> Column:
    tree = parse(source, timezone)
    compiler = _Compiler(source, spec, any(x.op in _ROW_OPS for x in _walk(tree)), positive)
    try:
        return compiler.boolean(tree, "filter")
    except FilterError:
        raise
    except SchemaError as e:
        raise FilterFieldError(str(e), source, tree.at) from e
