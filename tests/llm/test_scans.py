"""Operators that are one scan of the texts, against brute force."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from orrery.llm import decontam, html_extract, langid, license_scan, packing, pii, queries, sharding
from tests.llm import brute
from tests.llm.conftest import pairs

SF = "/root/testdata/sf0.001"


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_pii_base(request, which):
    docs = request.getfixturevalue(which)
    got = sorted(((r.doc_id, [(s["kind"], s["start"], s["end"]) for s in r.base], r.base_sha256) for r in pii.extract(docs).collect()), key=lambda r: (r[0] is None, str(r)))
    want = sorted(((d, b := brute.base_pii(t), brute.sha(",".join(f"{k}:{s}:{e}" for k, s, e in b).encode())) for d, t in pairs(docs)), key=lambda r: (r[0] is None, str(r)))
    assert got == want


def test_pii_bootstrap(spark):
    rows = [(i, f'x token = "{i:040x}" y') for i in range(6)] + [(10, 'has token = "unseen-99-form" here'), (11, "plain word 20240101x and the 12345678"), (12, None)]
    rows += [(20 + i, f"and password=b7db7aa4a5fcc7830{i} is") for i in range(3)] + [(30, "id=1234567890123456 id=2345678901234567 id=3456789012345678")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(s["start"], s["end"]) for s in r.secrets] for r in pii.extract(docs).collect()}
    assert got[10] == [(13, 27)] and got[11] == [] and got[12] == [] and got[0] == [(11, 51)] and got[20] == [(13, 31)] and got[30] == []
    red = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert red[10] == 'has token = "<SECRET>" here' and red[12] is None and red[11] == rows[7][1]


def test_pii_long_chain(spark):
    rows = [("p0", f"seed{i}", 1) for i in range(3)] + [("p0", "x1", 0)]
    rows += [e for k in range(1, 8) for e in ((f"p{k}", f"s{k}", 1), (f"p{k}", f"x{k}", 0), (f"p{k}", f"x{k + 1}", 0))]
    edges = spark.createDataFrame([*rows, ("other", "y1", 0), ("other", "y2", 0), ("other", "x8", 0)], "pattern string, value string, seed int")
    assert {r.pattern for r in pii.trusted_patterns(edges).collect()} == {f"p{k}" for k in range(8)}


@pytest.mark.parametrize("which", ["odd", "documents"])
@pytest.mark.parametrize("limit", [1 << 20, 2000])
def test_decontamination(request, spark, which, limit):
    docs = request.getfixturevalue(which)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(900, "again and again same"), (901, "mit license"), (902, None), (None, "a row without an id"), (901, "same words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    f = decontam.scan(docs, bench, limit=limit).select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ",").cast("binary"), 256), decontam.contaminated())
    assert sorted(map(tuple, f.collect()), key=key) == sorted(brute.decontaminate(pairs(docs), items), key=key)


def test_decontamination_cuts_passages(spark):
    item = "the quick brown fox jumps over the lazy dog while seven Wizards prepare a feast tonight"
    split = [" ".join(item.split()[:6]), " ".join(item.split()[6:])]
    body = " ".join(f"word{i}" for i in range(600))
    rows = [(1, f"Éa {body}. {item.upper()}! Then {body}", "a"), (2, item, "b"), (3, body, "c"), (4, None, "d"), (5, "", "e"), (6, f"{body} {split[0]} {item} {split[1]}", "f"), (None, f"{body}; {item}", "g"), (7, f"{item}: {body}", "h"), (8, f"{body} end {body} {body}", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits string").withColumn("n_chars", F.length("text"))
    bench = spark.createDataFrame([(1, item), (2, "end"), (None, body), (3, None)], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.clean(docs, bench).collect()}
    assert got[1].text == f"Éa {body}. Then {body}" and got[1].hits == "a" and got[1].n_chars == len(got[1].text)
    assert set(got) == {None, 1, 3, 4, 5, 6, 7, 8} and got[3].text == body and got[4].text is None and got[5].text == ""
    assert got[6].text == f"{body} " and got[None].text == f"{body}; " and got[7].text == body and got[8].text == f"{body} {body} {body}"
    assert not any(r[2] for r in brute.decontaminate([(d, r.text) for d, r in got.items()], [(1, item), (2, "end")]))
    assert decontam.clean(docs.limit(0), bench).count() == 0 and decontam.clean(docs, bench.limit(0)).count() == len(rows)


def test_decontamination_automaton_lanes(monkeypatch):
    import random

    rng = random.Random(5)
    monkeypatch.setattr(decontam, "LANE", 7)
    items = [(str(i), " ".join(rng.choice("abc") for _ in range(rng.randint(1, 40)))) for i in range(60)]
    docs = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 400)))) for i in range(40)] + [(99, " x ".join(t for _, t in items))]
    a, pairs = decontam.Automaton([(i, decontam.item_words(t)) for i, t in items]), decontam.PairMap(10)
    for _, t in items:
        pairs.add(decontam.item_words(t))
    want = {r[0]: r for r in brute.decontaminate(docs, items)}
    for d, t in docs:
        h = decontam.item_words(t)
        spans = a.match(h, *pairs.stretches(h, decontam.np.array([0, len(h)])))
        ids = a.items(spans[2])
        assert (sum(e - s for s, e in decontam._merged(*spans[:2])), len(ids), decontam.items_digest(ids)) == want[d][2:5]


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_license_base(request, which):
    docs = request.getfixturevalue(which)
    got = []
    for r in license_scan.detect(docs).collect():
        at = sorted(b["at"] for b in r.base)
        got.append((r.doc_id, r.n_words, len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted({b["label"] for b in r.base}))))
    assert sorted(got, key=key) == sorted(((d, *brute.license_base(t)) for d, t in pairs(docs)), key=key)


def test_license_diagonals(spark):
    text = license_scan.TEMPLATES[1][1].split()
    docs = spark.createDataFrame([(1, "intro " * 9 + " ".join([*text[:8], "indeed", *text[8:]]).title() + " end"), (2, "permission to copy the software"), (3, "Licensed under CC BY-NC 4.0.")], "doc_id long, text string")
    got = {r.doc_id: {(s["label"], s["first"]) for s in r.spans} for r in license_scan.detect(docs).collect()}
    assert ("mit", 9) in got[1] and not got[2] and got[3] == {("cc-by-nc", 0)}


def test_license_families(spark):
    cc = "This work is licensed under a Creative Commons Attribution{} License"
    texts = {
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation": {"gpl"},
        "Use it under the terms of the GNU General Public License as published by the Free Software Foundation.": {"gpl"},
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation": {"lgpl"},
        "under the terms of the GNU Library General Public License as published by the Free Software Foundation": {"lgpl"},
        "This work is licensed under the GNU Lesser General Public License version 3": {"lgpl"},
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation": {"agpl"},
        cc.format(" 4.0 International"): {"cc-by"},
        cc.format("-ShareAlike 4.0 International"): {"cc-by-sa"},
        cc.format("-NonCommercial 4.0 International"): {"cc-by-nc"},
        cc.format("-Non-Commercial 4.0 International"): {"cc-by-nc"},
        cc.format("-NonCommercial-ShareAlike 3.0 Unported"): {"cc-by-nc-sa"},
        cc.format("-NoDerivatives 4.0 International"): {"cc-by-nd"},
        cc.format("-ShareAlike 4.0 International") + ". " + "w " * 300 + cc.format("-NonCommercial 4.0 International"): {"cc-by-sa", "cc-by-nc"},
        "Licensed under CC BY-SA 4.0": {"cc-by-sa"},
        "Licensed under CC BY-NC-SA 4.0": {"cc-by-nc-sa"},
        "Licensed under CC BY-NC-ND 4.0": {"cc-by-nc-nd"},
    }
    docs = spark.createDataFrame([*enumerate(texts), *((1000 + i, "w " * (250 - i) + t) for i, t in enumerate(texts))], "doc_id long, text string")
    got = {r.doc_id: {s["label"] for s in r.spans} for r in license_scan.detect(docs).collect()}
    assert [got[i] for i in range(len(texts))] == [got[1000 + i] for i in range(len(texts))] == list(texts.values())


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_packing_round_trip(request, which):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(which)
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got, fills = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, path).collect():
        assert len(r.ids) == r.length > 0
        assert r.ids_crc32 == packing._crc(packing.np.array(r.ids, dtype=packing.np.uint32))
        got[r.doc_id].append((r.start, r.ids, r.doc_tokens))
        fills[r.sequence_id].append((r.offset, r.length))
    for f in fills.values():
        at = 0
        for o, n in sorted(f):
            assert o == at
            at += n
        assert at <= packing.WINDOW
    padding = sum(packing.WINDOW - sum(n for _, n in f) for f in fills.values())
    assert len(fills) < 4 or padding < 0.05 * packing.WINDOW * len(fills) + packing.WINDOW * docs.rdd.getNumPartitions()
    want = defaultdict(list)
    for d, t in pairs(docs):
        want[d].append(tok.encode(t or "", add_special_tokens=False).ids + [2])
    for d, texts in want.items():
        if len(texts) == 1:
            assert [i for _, ids, _ in sorted(got[d]) for i in ids] == texts[0] and all(x[2] == len(texts[0]) for x in got[d])
        else:
            assert sum(len(x[1]) for x in got[d]) == sum(map(len, texts))


def test_sum_of_squares_choice():
    p = packing.SumOfSquares(10)
    assert p.place(6) == (0, 0)
    assert p.place(4) == (0, 6)  # closing a window beats opening one
    assert p.place(10) == (1, 0)
    assert p.place(3) == (2, 0) and p.place(3)[0] in (2, 3)


def test_sum_of_squares_against_all_choices():
    import random

    rng = random.Random(9)
    for size, least in ((12, 1), (40, 3), (7, 1)):
        p, sizes = packing.SumOfSquares(size), [rng.randint(least, size) for _ in range(1500)]
        assert [p.place(n)[1] for n in sizes] == brute.squares(sizes, size)


def test_language_against_plain_counts(spark, odd, documents):
    some = [(r.text, r.lang) for r in documents.orderBy("doc_id").limit(40).collect()]
    train = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(some)], "doc_id long, text string, lang string").where(~langid.held_out(F.col("doc_id")))
    model = langid.fit(train)
    rows = [(r.doc_id, r.text) for r in odd.where("length(text) < 2000 OR text IS NULL").collect()] + [(100 + i, t[:700]) for i, (t, _) in enumerate(some[:12])] + [(200, "ÀÉÎ straße ﬁ \U00010400 x"), (201, "a"), (202, "7 b 7")]
    got = {str(r.doc_id) + str(r.text): (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model, ["doc_id", "text"]).collect()}
    want = brute.naive_bayes([(r.text, r.lang) for r in train.collect()], [t for _, t in rows], langid.ORDERS, langid.HASH_SIZE, langid.SMOOTHING)
    for (d, t), w in zip(rows, want):
        lang, score = got[str(d) + str(t)]
        assert (lang, score) == ("und", 0.0) if w is None else lang == w[0] and abs(score - w[1]) < 1e-2


@pytest.mark.parametrize("which", ["odd", "documents"])
@pytest.mark.parametrize("n", [3, 40])
def test_sharding(request, which, n):
    docs = request.getfixturevalue(which)
    rows = sharding.shard(docs, n).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=key) == sorted(((d, *brute.size_crc(t)) for d, t in pairs(docs)), key=key)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert set(by) <= set(range(n))
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    if which == "documents" and n == 3:
        loads = [sum(r.size for r in rs) for rs in by.values()]
        assert len(loads) == 3 and max(loads) - min(loads) <= 0.02 * max(loads)


def test_write_shards(spark, tmp_path, odd):
    docs = odd.unionByName(odd.where("doc_id IS NULL OR doc_id < 3")).withColumn("shard", F.lit(5))
    sharding.write_shards(docs, str(tmp_path / "s"), 3)
    got = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(str, got.select("doc_id", "text", "component", "h").collect())) == sorted(map(str, docs.select("doc_id", "text", "component", "h").collect()))
    by = defaultdict(list)
    for r in got.collect():
        by[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_sharding_of_one_row_many_times(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same").alias("text"))
    rows = sharding.shard(docs, 7).groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("s"), F.max("slot").alias("m")).collect()
    assert len(rows) == 7 and all(r.n == r.s == r.m + 1 and 400 <= r.n <= 450 for r in rows)
    assert len(sharding.splitters(docs.select(F.lit(1).cast("long").alias("h"), F.lit(1).cast("long").alias("d"), F.monotonically_increasing_id().alias("r"), F.lit(5).alias("size")), 8)) >= 7


def test_pii_values(spark):
    known = [(i, f"api_key: {i:032x}") for i in range(4)]
    found = {20: "eyJh.bGci/Oi+JI==", 21: "correcthorse", 22: "Zm9v/YmFy.", 23: "abc"}
    docs = spark.createDataFrame([*known, *((i, f"see api_key: {v} and more") for i, v in found.items()), (30, "Note: something else here"), (31, "api_key: me@example.org x"), (32, "the map_api_key: nothing")], "doc_id long, text string").withColumn("key", F.lit("k")).withColumn("_key", F.lit("x"))
    red = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert {i: red[i].text for i in found} == {20: "see api_key: <SECRET> and more", 21: "see api_key: <SECRET> and more", 22: "see api_key: <SECRET>. and more", 23: "see api_key: abc and more"}
    assert red[30].text == "Note: something else here" and red[31].text == "api_key: <EMAIL> x" and red[32].text == "the map_api_key: nothing"
    assert all(r["key"] == "k" and r["_key"] == "x" for r in red.values())


def test_license_words_in_order(spark):
    words = license_scan.TEMPLATES[1][1].split()
    grams = [" ".join(words[i : i + 3]) for i in range(0, len(words) - 2)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, ". x . ".join(grams[::-1])), (3, " ".join(words[:14]) + " quite " + " ".join(words[14:])), (4, None)], "doc_id long, text string")
    got = {r.doc_id: [(s["label"], round(s["cover"], 2)) for s in r.spans] for r in license_scan.detect(docs).collect()}
    assert got[1] == [("mit", 1.0)] and got[2] == [] and got[3][0][0] == "mit" and 0.9 < got[3][0][1] < 1 and got[4] == []
    assert license_scan.longest_chain([(1, 5), (2, 6), (2, 7), (3, 1), (4, 7), (5, 8)]) == 4


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    bench = spark.createDataFrame([], "item_id long, text string")
    import public_tokenizers

    assert pii.extract(docs).count() == license_scan.detect(docs).count() == decontam.scan(docs, bench).count() == sharding.shard(docs).count() == 0
    assert langid.identify(docs, langid.fit(docs)).count() == packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_language(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    rows = queries.op3_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows) > 0
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == got[4] == ("und", 0.0) and got[9][0] in model.langs
    assert all(0 <= s <= 1 for _, s in got.values())
    none = langid.identify(odd, langid.fit(odd)).collect()
    assert {r.lang_pred for r in none} == {"und"} and len(none) == odd.count()
