"""Planar geometry on WKT points and single-ring polygons. Boundaries belong to a shape."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.errors import SchemaError

EPS = 1e-9
_SHAPE = re.compile(r"\s*(?:POINT\s*\(([^()]*)\)|POLYGON\s*\(\s*\(([^()]*)\)\s*\))\s*", re.IGNORECASE)

#: A shape is the list of its corners: one for a point, a closed ring for a polygon.
Shape = list[tuple[float, float]]


def parse_wkt(text: object) -> Shape:
    m = _SHAPE.fullmatch(text) if isinstance(text, str) else None
    if m is None:
        raise SchemaError("a geometry is the WKT of a point or of a polygon with one ring")
    corners: Shape = []
    for pair in (m[1] if m[1] is not None else m[2]).split(","):
        try:
            x, y = map(float, pair.split())
        except ValueError as e:
            raise SchemaError(f"{pair!r} is not a pair of coordinates") from e
        if not (math.isfinite(x) and math.isfinite(y)):
            raise SchemaError("coordinates have to be finite")
        corners.append((x, y))
    if m[1] is not None:
        if len(corners) != 1:
            raise SchemaError("a point has one pair of coordinates")
        return corners
    if len(corners) < 4 or corners[0] != corners[-1]:
        raise SchemaError("a polygon is a closed ring of at least 4 pairs")
    sides = list(zip(corners, corners[1:]))
    for i in range(len(sides)):
        for j in range(i + 2, len(sides) - (i == 0)):
            if _cross(*sides[i], *sides[j]):
                raise SchemaError("a polygon's ring must not cross itself")
    return corners


def _turn(a, b, c) -> int:  # noqa: ANN001
    v = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return (v > EPS) - (v < -EPS)


def _on(p, a, b) -> bool:  # noqa: ANN001
    v = (p[1] - a[1]) * (b[0] - a[0]) - (p[0] - a[0]) * (b[1] - a[1])
    return abs(v) <= EPS and all(min(a[k], b[k]) - EPS <= p[k] <= max(a[k], b[k]) + EPS for k in (0, 1))


def _cross(a, b, c, d) -> bool:  # noqa: ANN001
    """Whether the segments ab and cd share a point."""
    t = (_turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b))
    if any(x == 0 and _on(p, *s) for x, p, s in zip(t, (c, d, a, b), ((a, b), (a, b), (c, d), (c, d)))):
        return True
    return (t[0] > 0) != (t[1] > 0) and (t[2] > 0) != (t[3] > 0)


def _holds(ring: Shape, p) -> bool:  # noqa: ANN001
    inside = False
    for a, b in zip(ring, ring[1:]):
        if _on(p, a, b):
            return True
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (a[0] - b[0]) * (p[1] - b[1]) / (a[1] - b[1]) + b[0]:
            inside = not inside
    return inside


def _sides(s: Shape) -> list:
    return list(zip(s, s[1:])) or [(s[0], s[0])]


def contains(a: Shape, b: Shape) -> bool:
    """Whether every point of ``b`` belongs to ``a``."""
    if len(a) == 1:
        return a == b
    if not all(_holds(a, p) for p in b):
        return False
    for c, d in _sides(b) if len(b) > 1 else ():
        if not _holds(a, ((c[0] + d[0]) / 2, (c[1] + d[1]) / 2)):
            return False
        for e, f in _sides(a):
            aligned = _turn(e, f, c) == 0 and _turn(e, f, d) == 0
            if not aligned and _cross(e, f, c, d) and not _on(c, e, f) and not _on(d, e, f):
                return False
    return True


def within(a: Shape, b: Shape) -> bool:
    return contains(b, a)


def intersects(a: Shape, b: Shape) -> bool:
    if len(a) == 1 and len(b) == 1:
        return a == b
    if len(a) == 1 or len(b) == 1:
        return _holds(b, a[0]) if len(a) == 1 else _holds(a, b[0])
    return any(_cross(*s, *t) for s in _sides(a) for t in _sides(b)) or _holds(b, a[0]) or _holds(a, b[0])


def _gap(p, a, b) -> float:  # noqa: ANN001
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n)) if n > 1e-24 else 0.0
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def distance(a: Shape, b: Shape) -> float:
    if intersects(a, b):
        return 0.0
    ends = [(p, s) for s in _sides(b) for p in a] + [(p, s) for s in _sides(a) for p in b]
    return min(_gap(p, *s) for p, s in ends)


def valid(text: object) -> bool:
    try:
        parse_wkt(text)
    except SchemaError:
        return False
    return True


_TESTS = {"contains": contains, "within": within, "intersects": intersects}


def predicate(col: Column, op: str, wkt: str, most: float | None = None) -> Column:
    """contains, within, intersects or dwithin of a WKT column and a constant; null and invalid shapes are False."""
    fixed = parse_wkt(wkt)
    test = _TESTS.get(op) or (lambda a, b: distance(a, b) <= most + EPS)

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        def one(t: object) -> bool:
            try:
                return bool(test(parse_wkt(t), fixed))
            except SchemaError:
                return False

        return s.map(one)

    return run(col)


def is_valid(col: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(valid)

    return F.coalesce(run(col), F.lit(False))
