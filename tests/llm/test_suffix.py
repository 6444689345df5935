"""Repeated windows against brute force."""

import pytest

from orrery.llm import suffix_dedup
from tests.llm import brute
from tests.llm.conftest import pairs


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("which,width", [("odd", 400), ("odd", 20), ("documents", 400), ("documents", 50)])
def test_repeated(request, which, width):
    docs = request.getfixturevalue(which)
    got = suffix_dedup.repeated_spans(docs, width)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute.repeated_bytes(pairs(docs), width), key=key)


@pytest.mark.parametrize("which,passage", [("odd", 51), ("odd", 5), ("documents", 51), ("documents", 6)])
def test_passages(request, which, passage):
    docs = request.getfixturevalue(which)
    got = suffix_dedup.repeated_spans(docs, passage=passage)
    assert sorted([(r.doc_id, r.n_shared_words) for r in got.collect()], key=key) == sorted(brute.shared_words(pairs(docs), passage), key=key)
    assert sorted(map(tuple, got.drop("n_shared_words").collect()), key=key) == sorted(brute.repeated_bytes(pairs(docs)), key=key)


def test_passages_within_and_across(spark):
    import random

    rng = random.Random(11)
    some = lambda n: " ".join(rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(n))
    p, q, r = some(60), some(51), some(50)
    texts = [f"{some(30)} {p} {some(10)} {p}", f"{some(20)} {p[:-3]}", f"{q.upper()}. {some(80)}", f"{some(9)}\n{q}", f"{r} {some(9)}", f"{some(9)} {r}", f"{some(5)} {some(55)} {q} {p}", (x := some(70)), x, f"{x} {x} {some(3)}", some(49) + " one", some(90)]
    y = some(120)
    texts += [f"{y} {some(4)} {y}", some(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {z.doc_id: z.n_shared_words for z in suffix_dedup.repeated_spans(docs, passage=51).collect()}
    want = dict(brute.shared_words(pairs(docs)))
    assert got == want and got[12] == 0 and got[4] == 0 and got[2] == 51 and got[7] == 70


def test_long_text_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_BLOCK", 1000)
    import random

    rng = random.Random(3)
    body = "".join(rng.choice("abcdefgh ") for _ in range(9000))
    docs = spark.createDataFrame([(1, body), (2, "zz" + body[1500:4200] + "yy" + body[300:800])], "doc_id long, text string")
    d, o = suffix_dedup.buffers(suffix_dedup.pa.array([body]))
    assert len(suffix_dedup.runs(d, o)[0]) > 9
    assert sorted(map(tuple, suffix_dedup.repeated_spans(docs).collect())) == brute.repeated_bytes(pairs(docs))


def test_kept_text_and_empty(spark):
    a = "".join(chr(97 + i * i % 23) for i in range(700))
    docs = spark.createDataFrame([(1, a + "left"), (2, "right" + a)], "doc_id long, text string")
    assert {r.doc_id: bytes(r.kept) for r in suffix_dedup.repeated_spans(docs, with_text=True).collect()} == {1: b"left", 2: b"right"}
    assert suffix_dedup.repeated_spans(docs.limit(0)).count() == 0
