import pytest

ODD = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "..., !?"),
    (5, "one"),
    (6, "The MIT License and the mit  license; Apache License. GNU General Public License"),
    (7, "mail a.b+c@x-y.example.org, a@b, @c.d, x@y.z@w.v and +1 (555) 123-4567 or 10.0.0.256 or 1.2.3.4.5.6.7.8"),
    (8, "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111, +49 30 1234567890123 999.1.1.1"),
    (9, "é ñ ü ß 中文 \U0001f600 \U00020000 İstanbul ΣΑΣ"),
    (10, "same words here again and again " * 40),
    (10, "same words here again and again " * 40),
    (11, "same words here again and again " * 40),
    (12, "a" * 5000),
    (13, "long " * 60000),
    (None, "a row without an id"),
    (14, "x" + "ab" * 700 + "y" + "ab" * 300),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with the operators' own names."""
    rows = [(d, t, None, "s", 0, 1, "k", 2, "h") for d, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, key string, component int, h string")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
