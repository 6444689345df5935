"""The filter language on rows with nulls; expected keys are worked out by hand from the null rules."""

from datetime import UTC, datetime

import pytest

from orrery.errors import FilterError, FilterFieldError, FilterParseError, FilterTypeError
from orrery.plans.filter import parse, predicate, to_column, tokenize
from orrery.schema import CollectionSpec, FieldSpec

SPEC = CollectionSpec(
    (
        FieldSpec("id", "VARCHAR", primary=True),
        FieldSpec("age", "INT64", nullable=True),
        FieldSpec("title", "VARCHAR", nullable=True),
        FieldSpec("score", "DOUBLE"),
        FieldSpec("active", "BOOL"),
        FieldSpec("tags", "ARRAY", element="VARCHAR", nullable=True),
        FieldSpec("marks", "ARRAY", element="INT64", nullable=True),
        FieldSpec("info", "JSON", nullable=True),
        FieldSpec("shape", "GEOMETRY", nullable=True),
        FieldSpec("at", "TIMESTAMPTZ", nullable=True),
        FieldSpec("vec", "FLOAT_VECTOR", dim=2),
    ),
    dynamic=True,
)
T0 = datetime(2024, 1, 1, tzinfo=UTC)
ROWS = [
    ("a", 10, "Red fox", 0.5, True, ["x", "y"], [1, 2, 3], '{"n": 1, "s": "one", "l": [1, "a", true], "d": {"e": [5, 6]}}', "POINT(1 1)", T0, [1.0, 0.0], '{"color": "red", "size": 3}'),
    ("b", 30, None, 1.5, False, None, [], '{"n": "1", "s": null}', "POINT(20 20)", T0.replace(month=2), [0.0, 1.0], '{"color": "blue", "size": "3"}'),
    ("c", None, "100% wool_x", -2.0, True, [], None, None, "POLYGON((0 0, 0 4, 4 4, 4 0, 0 0))", None, [1.0, 1.0], None),
    ("d", 70, "blue Fox!", 0.0, False, ["y", "z"], [9], '[1, 2, "q"]', None, T0.replace(year=2025), [1.0, 2.0], '{"size": null, "ok": true}'),
    ("e", -5, "", 9.25, True, ["x"], [3, 3], "not json", "nonsense", T0, [2.0, 2.0], "broken"),
]

CASES = [
    ("age > 10", "bd"),
    ("age >= 10 and active", "a"),
    ("not (age > 10)", "ae"),
    ("age == 10 or title is null", "ab"),
    ("age in [10, 70]", "ad"),
    ("age not in [10, 70]", "bce"),
    ("not (age in [10])", "bcde"),
    ("age not in [10] and array_length(tags) >= 0", "bde"),
    ("age in []", ""),
    ("age not in []", "abcde"),
    ("title like '%ox%'", "ad"),
    ("title like '100\\\\%%'", "c"),
    ("title like 'Red_fox'", "a"),
    ("title is not null && !active", "d"),
    ("score / 0 > 100", "abe"),
    ("score * 2 + 1 == 2.0", "a"),
    ("age - 5 * 2 < 0", "e"),
    ("-age > 0", "e"),
    ("age / 4 == 2.5", "a"),
    ("9223372036854775807 + age > 0", "e"),
    ("active == true", "ace"),
    ("TRUE and age < 0", "e"),
    ("1 < 2 == true", "abcde"),
    ('color == "red"', "a"),
    ('$meta["color"] != "red"', "b"),
    ("size == 3", "a"),
    ("size != 3", "b"),
    ("size > 2", "a"),
    ('size in ["3"]', "b"),
    ("exists size", "ab"),
    ("exists $meta['ok']", "d"),
    ("ok", "d"),
    ("size is null", "cde"),
    ('info["n"] == 1', "a"),
    ("info['n'] == '1'", "b"),
    ("info['n'] != 1", "b"),
    ("info['s'] is null", "bcde"),
    ('info["d"]["e"][1] == 6', "a"),
    ("info[0] == 1", "d"),
    ("json_contains(info['l'], 'a')", "a"),
    ("json_contains(info, 'q')", "d"),
    ("json_contains_all(info['l'], [1, true])", "a"),
    ("json_contains_any(info['l'], [7, 1])", "a"),
    ("not json_contains(info['l'], 1)", "bcde"),
    ("array_contains(tags, 'x')", "ae"),
    ("array_contains_all(tags, ['x', 'y'])", "a"),
    ("array_contains_any(tags, ['z', 'x'])", "ade"),
    ("array_contains(marks, 3)", "ae"),
    ("array_length(marks) == 0", "bc"),
    ("marks[0] == 9", "d"),
    ("tags[5] == 'x'", ""),
    ("text_match(title, 'FOX wool_x')", "acd"),
    ("not text_match(title, 'fox')", "bce"),
    ("st_within(shape, 'POLYGON((0 0, 0 10, 10 10, 10 0, 0 0))')", "ac"),
    ("ST_CONTAINS(shape, 'POINT(4 2)')", "c"),
    ("geometry_intersects(shape, 'POLYGON((3 3, 5 3, 5 5, 3 5, 3 3))')", "c"),
    ("st_dwithin(shape, 'POINT(1 3)', 2)", "ac"),
    ("not ST_ISVALID(shape)", "de"),
    ("at == ISO '2024-01-01T00:00:00Z'", "ae"),
    ("at > ISO '2024-01-01T00:00:00' + INTERVAL 'P7D'", "bd"),
    ("at - INTERVAL 'PT1S' < iso '2024-01-01T00:00:00Z'", "ae"),
    ("info == '[1, 2, \"q\"]'", "d"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SPEC.struct()).cache()


def test_cases(rows):
    # all conditions in one job
    flags = rows.select("id", *[to_column(e, SPEC, "UTC").alias(f"c{i}") for i, (e, _) in enumerate(CASES)]).collect()
    got = [(e, "".join(r.id for r in flags if r[f"c{i}"])) for i, (e, _) in enumerate(CASES)]
    assert got == CASES
    assert not any(v is None for r in flags for v in r)
    kept = rows.select("id", *[predicate(e, SPEC, "UTC").alias(f"c{i}") for i, (e, _) in enumerate(CASES)]).collect()
    assert [(e, "".join(r.id for r in kept if r[f"c{i}"])) for i, (e, _) in enumerate(CASES)] == CASES


def test_pushdown(spark, tmp_path, capsys):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, 2.0, "a")], "age long, score double, title string").write.parquet(path)
    spec = CollectionSpec((FieldSpec("id", "INT64", primary=True), FieldSpec("age", "INT64"), FieldSpec("score", "DOUBLE"), FieldSpec("title", "VARCHAR"), FieldSpec("v", "FLOAT_VECTOR", dim=1)))
    spark.read.parquet(path).where(predicate("age > 3 and score <= 1.5 and title in ['a', 'b']", spec)).select("age").explain("formatted")
    plan = capsys.readouterr().out
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "GreaterThan(age,3)" in pushed and "LessThanOrEqual(score,1.5)" in pushed and "In(title" in pushed


@pytest.mark.parametrize(
    "source,error,word",
    [
        ("", FilterParseError, "empty"),
        ("age = 1", FilterParseError, "=="),
        ("age <> 1", FilterParseError, "!="),
        ("active & active", FilterParseError, "&&"),
        ("active | active", FilterParseError, "||"),
        ("age in 3", FilterParseError, "expected"),
        ("1 in [1]", FilterParseError, "field"),
        ("age >", FilterParseError, "end"),
        ("(age > 1", FilterParseError, "end"),
        ("title like 5", FilterParseError, "pattern"),
        ("info[-1] == 1", FilterParseError, "index"),
        ("'abc", FilterParseError, "without an end"),
        ("'a\\q' == title", FilterParseError, "escape"),
        ("foo(age)", FilterParseError, "unknown function"),
        ("INTERVAL 'P1Y' == 3", FilterParseError, "interval"),
        ("at > ISO 'yesterday'", FilterParseError, "ISO"),
        ("age == 'x'", FilterTypeError, "compare"),
        ("title > 3", FilterTypeError, "compare"),
        ("age and active", FilterTypeError, "condition"),
        ("age + 1", FilterTypeError, "condition"),
        ("title + 1 == 2", FilterTypeError, "numbers"),
        ("age in ['x']", FilterTypeError, "list"),
        ("age in [1, 'x']", FilterTypeError, "mixes"),
        ("age like 'x'", FilterTypeError, "text"),
        ("exists age", FilterTypeError, "exists"),
        ("vec == 1", FilterTypeError, "FLOAT_VECTOR"),
        ("_seq > 1", FilterFieldError, "reserved"),
        ("st_within(title, 'POINT(1 1)')", FilterTypeError, "GEOMETRY"),
        ("st_within(shape, 'LINE(1 1)')", FilterTypeError, "WKT"),
    ],
)
def test_errors(spark, source, error, word):
    with pytest.raises(error, match=None) as e:
        to_column(source, SPEC)
    assert word in str(e.value) and isinstance(e.value, FilterError)


def test_unknown_field_and_position(spark):
    fixed = CollectionSpec(SPEC.fields)
    with pytest.raises(FilterFieldError) as e:
        to_column("age > 1 and nope == 2", fixed)
    assert e.value.position == 12
    with pytest.raises(FilterFieldError):
        to_column("$meta['x'] == 1", fixed)


def test_tokens_and_precedence():
    assert [t.kind for t in tokenize("a AND not b || 1.5e3 - .5")] == ["name", "word", "word", "name", "word", "float", "op", "float", "end"]
    n = parse("a or b and not c == 1 + 2 * 3")
    assert n.op == "or" and n.args[1].op == "and" and n.args[1].args[1].op == "not"
    assert parse("-3 < x").args[1].args == ("int", -3)
