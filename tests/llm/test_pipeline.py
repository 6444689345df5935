"""The pipeline's stages against brute force, stage by stage."""

import corpus_pipeline as P
from orrery.llm import langid
from tests.llm import brute
from tests.llm.conftest import pairs

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(90001, "1234 !!!", "en", "s", 8), (90002, None, None, "s", None), (90003, "", None, "s", 0)], docs.schema)
    docs = docs.unionByName(odd)
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        assert name == "packing" or docs.columns == columns

    before, after = seen["language_id"]
    kept = {r.doc_id for r in after.collect()}
    pred = {r.doc_id: r for r in langid.identify(before, langid.fit(before)).collect()}
    assert kept == {d for d, r in pred.items() if r.lang_pred != "und" and r.score >= P.MIN_SCORE} and not kept & {90001, 90002, 90003}
    assert len(kept) >= 199

    before, after = seen["near_duplicates"]
    assert sorted(d for d, _ in pairs(after)) == sorted(d for d, _, _, c in brute.jaccard_links(pairs(before)) if d == c)

    before, after = seen["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    judged = {r[0]: r for r in brute.decontaminate(pairs(before), items)}
    assert sorted(d for d, _ in pairs(after)) == sorted(d for d, r in judged.items() if not r[5])
    assert not any(r[2] for r in brute.decontaminate(pairs(after), items))
    texts = dict(pairs(before))
    assert {d for d, t in pairs(after) if t != texts[d]} == {d for d, r in judged.items() if r[2] and not r[5]}

    before, after = seen["personal_data"]
    texts = dict(pairs(after))
    assert set(texts) == {d for d, _ in pairs(before)}
    for d, t in pairs(before):
        assert brute.base_pii(t) or "token" in t or texts[d] == t
        assert not [s for s in brute.base_pii(texts[d]) if s[0] in ("email", "phone")]
    assert all(r.n_chars == len(r.text) for r in after.join(before.select("doc_id", before.text.alias("old")), "doc_id").where("old != text").collect())

    before, after = seen["packing"]
    assert {r.doc_id for r in after.collect()} == set(texts)


def test_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, ""), (None, "x y")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in P.drop_near_duplicates(spark, docs, "").collect()) == ["1", "3", "None"]


def test_repeated_and_null_ids_of_other_texts(spark):
    a, b, c, d = ("a b c d e f g", "h i j k l m n", "o p q r s t u", "v w x y z a b")
    rows = [(1, a, "s"), (2, a, "s"), (2, b, "s"), (3, c, "s"), (3, d, "s"), (3, d, "r"), (None, a, "s"), (None, c, "s"), (None, "p q r", "s"), (None, "p q r", "s"), (None, "k l m", "s"), (4, "k l m", "s"), (None, None, "s"), (None, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = [(1, a, "s"), (2, b, "s"), (3, c, "s"), (3, d, "r"), (None, "p q r", "s"), (4, "k l m", "s"), (None, None, "s"), (None, "", "s")]
    assert sorted(map(str, map(tuple, P.drop_near_duplicates(spark, docs, "").collect()))) == sorted(map(str, want))


def test_run(spark):
    assert P.run(spark, SF).count() > 100


def test_many_copies_to_drop(spark, monkeypatch):
    """With more dropped rows than a broadcast takes, only texts that may be dropped are joined; null and repeated ids included."""
    monkeypatch.setattr(P, "BROADCAST_BYTES", 0)
    text = "a b c d e f g h i j k l m n"
    rows = [(i, f"{text} {i}") for i in range(3)] + [(None, f"{text} 1"), (7, "x y z"), (7, "x y z"), (7, "u v w"), (8, None), (9, text), (9, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = P.drop_near_duplicates(spark, docs, SF)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftAnti") < plan.rindex("ArrowEvalPython")
    assert sorted(map(tuple, got.collect())) == [(0, f"{text} 0"), (7, "u v w"), (7, "x y z"), (8, None)]
