"""The Jaccard join against brute force."""

import random
import time

import numpy as np
import pytest

from orrery.llm import common, ngram_join
from tests.llm import brute
from tests.llm.conftest import pairs


def key(row):
    return tuple((x is not None, x) for x in row)


def near_copies(n):
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    base = [rng.choice(vocab) for _ in range(220)]
    rows = []
    for i in range(n):
        w = list(base if i % 3 else base[:180] + [rng.choice(vocab) for _ in range(60)])
        for _ in range(rng.randrange(7)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((1000 + i, " ".join(w)))
    return rows


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_join(request, which):
    docs = request.getfixturevalue(which)
    got = ngram_join.similar_sets(docs)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute.jaccard_links(pairs(docs)), key=key)


@pytest.mark.parametrize("ball,hot,skip", [(8, 100_000, 32), (2, 3, 1), (128, 1, 5), (2, 100_000, 4)])
def test_many_near_copies(spark, monkeypatch, ball, hot, skip):
    monkeypatch.setattr(ngram_join, "SKIP", skip)
    monkeypatch.setattr(ngram_join, "BALL_SETS", ball)
    monkeypatch.setattr(ngram_join, "HOT_LIST", hot)
    docs = spark.createDataFrame(near_copies(90) + near_copies(5), "doc_id long, text string").repartition(3)
    if hot == 3:
        found = []
        plain = ngram_join._hot_grams
        monkeypatch.setattr(ngram_join, "_hot_grams", lambda *a: found.append(plain(*a)) or found[-1])
    got = ngram_join.similar_sets(docs)
    assert hot != 3 or max(found[0].values()) > 1
    want = brute.jaccard_links(pairs(docs))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert max(r[2] for r in want) > 30


def test_overlaps():
    rng = np.random.default_rng(1)
    for m, n, top in ((5, 3, 99), (1, 4, 99), (1, 1, 99), (6, 6, 40_000)):
        base = np.unique(rng.integers(0, top, top // 2).astype(np.uint64))
        near = lambda: np.unique(np.r_[rng.choice(base, len(base) * 9 // 10), rng.integers(0, top, top // 9).astype(np.uint64)])
        a, b = [near() for _ in range(m)], [near() for _ in range(n)]
        x, y = (ngram_join.Ball(ngram_join._freeze([(i, i + 1, s) for i, s in enumerate(z)])) for z in (a, b))
        assert ngram_join.overlaps(x, y).tolist() == [[len(np.intersect1d(s, t)) for t in b] for s in a]
        assert ngram_join.overlaps(x, x).tolist() == [[len(np.intersect1d(s, t)) for t in a] for s in a]
        assert x.ids.tolist() == list(range(m)) and x.copies.tolist() == list(range(1, m + 1)) and x.sizes.tolist() == [len(s) for s in a]


def test_bitmaps_rule_out_no_link():
    """Whatever pair of balls the bitmaps rule out has no link; most pairs of unlike sets are ruled out."""
    rng = np.random.default_rng(2)
    out = {True: 0, False: 0}
    for i in range(600):
        n = int(rng.integers(1, 90))
        base = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        share = rng.choice([0.1, 0.5, 0.85, 0.95])
        near = lambda: np.unique(np.r_[base[rng.random(len(base)) < share], rng.integers(0, 1 << 63, int(rng.integers(1, 2 + n // 20))).astype(np.uint64)])  # noqa: B023, E731
        sides = [[near() for _ in range(rng.integers(1, 4))] for _ in range(2)]
        balls = []
        for sets in sides:
            size = min(len(ngram_join.bitmap(s)) for s in sets)
            maps = [ngram_join.folded(ngram_join.bitmap(s), size) for s in sets]
            every, some = maps[0], maps[0]
            for m in maps[1:]:
                every, some = every & m, some | m
            balls.append((min(map(len, sets)), max(map(len, sets)), every.to_bytes(size, "little"), some.to_bytes(size, "little")))
        link = any(ngram_join.DEN * (o := len(np.intersect1d(s, t))) >= ngram_join.NUM * (len(s) + len(t) - o) for s in sides[0] for t in sides[1])
        assert ngram_join.may_link(*balls) or not link
        assert ngram_join.may_link(*balls) == ngram_join.may_link(*balls[::-1])
        out[link] += ngram_join.may_link(*balls)
    assert out[True] > 50 and out[False] < 300


def test_sets_of_unlinked_balls_stay_where_they_are(spark, monkeypatch):
    """Texts that share a few grams and have no link are compared by their bitmaps only; linked ones are found."""
    shared = [f"s{i}" for i in range(60)]
    rows = [(i, " ".join([f"w{i}_{k}" for k in range(120)] + shared)) for i in range(40)]
    rows += [(100 + i, t + " end") for i, t in rows[:3]]
    fetched = []
    plain = ngram_join._payloads
    monkeypatch.setattr(ngram_join, "_payloads", lambda members, docs: fetched.append(members.count()) or plain(members, docs))
    monkeypatch.setattr(ngram_join, "_levels", lambda parts: np.zeros(ngram_join.CELLS, dtype=np.uint8))  # as in a large table, where no gram looks rare
    monkeypatch.setattr(ngram_join, "BROADCAST_BYTES", 0)  # the way of many members
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.similar_sets(docs)
    assert sorted(map(tuple, got.collect())) == sorted(brute.jaccard_links(pairs(docs)))
    assert fetched == [6]


def test_shuffle_files_are_removed(spark, tmp_path):
    """A write within leaves no shuffle file behind, and the setting is as before afterwards."""
    count = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, plain = count(), spark.conf.get(name)
    with common.shuffles_removed(spark):
        assert spark.conf.get(name) == "true"
        for i in range(5):
            spark.range(1000).repartition(7, "id").write.parquet(f"{tmp_path}/{i}")
    end = time.time() + 20
    while count() > before and time.time() < end:
        time.sleep(0.2)
    assert count() <= before and spark.conf.get(name) == plain


def test_equal_rows_and_texts_of_one_id(spark):
    """Many rows without an id and rows of one id with other texts, repeated as they are."""
    texts = ["a b c d e f g h", "a b c d e f g h i", "k l m n o p q r", "one two"]
    rows = [(None, t) for t in texts for _ in range(4)] + [(7, t) for t in texts[::-1] for _ in range(2)] + [(9, texts[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, ngram_join.similar_sets(docs).collect()), key=key) == sorted(brute.jaccard_links(pairs(docs)), key=key)


def test_empty(spark):
    assert ngram_join.similar_sets(spark.createDataFrame([], "doc_id long, text string")).count() == 0
