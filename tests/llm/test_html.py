"""Main-text extraction: held-out labelled pages, the table's pages, and odd markup."""

import html
import re

import pytest

from orrery.llm import html_extract as H


@pytest.fixture(scope="module")
def model():
    return H.fit()


def test_held_out_blocks(model):
    hit = extra = miss = 0
    for text, page in zip(H.main_text(pages := H.labelled_pages(200, seed=77), model), pages):
        want = {t for t in H.parse(page).text if t and (t == "qq" or t.startswith("qq "))}
        got = set(text.split("\n\n")) - {""}
        hit, extra, miss = hit + len(want & got), extra + len(got - want), miss + len(want - got)
    assert hit > 0.95 * (hit + extra) and hit > 0.95 * (hit + miss)


def article(page):
    i, j = page.index("<article>") + 9, page.find("</article>")
    parts = re.split(r"</?(?:p|h1)>", page[i : j if j >= 0 else None])
    parts = [" ".join(html.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in parts]
    return "\n\n".join(p for p in parts if p)


def test_pages_table(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    got = {r.page_id: r for r in H.extract(pages, model).collect()}
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_odd_pages(spark, model):
    long = "<article><h1>T</h1>" + "<p>some words of text here, quite a few.</p>" * 20000 + "</article>"
    rows = [(1, "u", None), (2, "u", ""), (3, None, "plain < text & no tags"), (4, "u", "<div><p>a<b>c<!-- x"), (5, "u", "</p></div><script>if (a<b) x('</p>')"), (6, "u", "<article><p>one&nbsp;&lt;two&gt;\n\n three &eacute;</p><p>four <i>fi</i>ve." + "</article><div class='comments'><p>me too, thanks.</p></div>"), (7, "u", long), (7, "u", long), (None, "u", "<nav><a href=x>home</a></nav>"), (9, "u", "<" * 3000 + "div" * 10), (10, "u", "<div" * 5000)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: r.text for r in H.extract(df, model).collect()}
    assert len(got) == 10 and got[1] == got[2] == got[5] == ""
    assert got[6] == "one <two> three é\n\nfour five."
    assert got[7].count("\n\n") == 20000
    assert H.extract(df.limit(0), model).count() == 0


def texts(page):
    return [t for t in H.parse(page).text if t]


def test_open_head(model):
    article = "<article><h1>T</h1><p>some words of text here, quite a few.</p></article>"
    head = "<html><head><meta charset=utf-8><title>t</title><script>x<y</script>"
    want = H.main_text([f"{head}</head><body>{article}</body></html>"], model)
    assert want[0].endswith("quite a few.")
    assert H.main_text([f"{head}<body>{article}</body></html>", f"{head}{article}", f"{head}<body>{article}</html>"], model) == want * 3
    assert texts(f"{head}plain <b>text</b>") == ["plain text"] and texts(f"{head}<template><p>x</p></template></head><p>y") == ["y"]


def test_open_silent_elements():
    for tag in ("button", "select", "svg", "dialog", "template", "canvas", "textarea", "iframe"):
        assert texts(f"<div><{tag}><p>one</p></div><p>two</p><{tag}>no</{tag}><p>three</p>")[-2:] == ["two", "three"] or tag in ("textarea", "iframe")
        assert texts(f"<p>zero</p><{tag}><p>one</p><p>two</p>") == ["zero", "one", "two"]
    assert texts("<select><option>a<option>b</select><p>c") == ["c"] and texts("<svg><text>a</svg><p>b") == ["b"]
    assert texts("<p>a</p><script>b<p>c</p>") == ["a"] and len(texts("<button>" * 3000 + "<p>x")) == 1


def test_formulas_and_fallbacks():
    assert texts("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</p>") == ["so x=2 holds"]
    assert texts("<p>a</p><object data=x><p>b</p></object><p>c</p>") == ["a", "b", "c"]


def test_messages_against_enumeration(model):
    import itertools

    import numpy as np

    page = H.parse("<body><article><p>a b c d e f.</p></article></body>")
    n = len(page.parent)
    own = np.array([sum((model.own.get(f, np.zeros(3)) for f in fs), np.zeros(3)) for fs in page.feats])
    total = np.zeros((n, 3))
    for ys in itertools.product(range(3), repeat=n):
        s = model.root[ys[0]] + sum(own[i, y] for i, y in enumerate(ys)) + sum(model.edge[ys[page.parent[i]], ys[i]] for i in range(1, n))
        for i, y in enumerate(ys):
            total[i, y] += np.exp(s)
    assert np.allclose(model.marginals([page])[0], total / total.sum(axis=1, keepdims=True))
