"""Main-text extraction with a tree-structured graphical model over the DOM.

Nodes of the model are the block elements of a page and its text blocks (leaves). Every node is *content*, *mixed* (it holds
content and other things) or *other*. A node's own potential comes from its tag, the words of its class, id
and role, its text length and share of links; parent-child potentials tie it to the node above. Messages pass
up and down the tree (sum-product), for all pages of a batch level by level, and give each leaf's marginal of being content.
All potentials are smoothed counts over labelled pages, which ``labelled_pages`` builds from a fixed seed.
"""

from __future__ import annotations

import html as _html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orrery.llm.common import bounded_batches

CONTENT, MIXED, OTHER = 0, 1, 2
#: Labelled pages that the potentials are counted on.
FIT_PAGES = 600
SMOOTHING = 0.5

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is markup, code or controls, never text.
_SILENT = frozenset("script style template noscript head title textarea select option button svg iframe canvas audio video map datalist dialog annotation annotation-xml".split())
_RAW = frozenset("script style textarea title iframe noscript".split())
#: Tags that a head may hold; any other one, or text, closes a head whose end tag is left out.
_HEAD = frozenset("base basefont bgsound html link meta noframes noscript script style template title".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr br img"
    " math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle mpadded mfenced menclose msub msup msubsup munder mover munderover mmultiscripts semantics annotation annotation-xml".split()
)
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
_TAG = re.compile(r"<!--(?P<c>.*?)(?:-->|\Z)|<(?P<e>/?)(?P<t>[a-zA-Z][^\s/>]*)(?P<a>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[a-z]+")
#: Endings of the words of class, id and role that tell something; a word stands for the first that it begins with.
_STEMS = (
    "nav complementary contentinfo menu breadcrumb header masthead footer sidebar side aside ad ads advert sponsor promo banner cookie consent notice alert popup modal subscribe newsletter signup login search form comment comments reply respond disqus related recommend share social tag widget pagination pager copyright legal skip toolbar rail meta author byline"
    " article content main post entry story body text page document prose markdown section wrapper container title headline lead summary caption quote hidden"
).split()


@lru_cache(maxsize=20_000)
def _attr_words(raw: str) -> tuple[str, ...]:
    """The telling words of a tag's attributes."""
    found = set()
    for name, a, b, c in _ATTR.findall(raw):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id", "role", "itemprop", "aria-label", "data-role"):
            for w in _WORD.findall(value):
                if w in _STEMS:
                    found.add(w)
                else:
                    found |= {s for s in _STEMS if len(s) > 3 and w.startswith(s)}
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            found.add("hidden")
    if re.search(r"(?:^|\s)hidden(?:\s|=|$)", raw):
        found.add("hidden")
    return tuple(sorted(found))


@dataclass
class Page:
    """The tree of a page: for each node its parent (-1: none), depth and features; texts by leaf, None elsewhere."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    feats: list[list[str]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    element: list[str] = field(default_factory=list)
    attrs: list[str] = field(default_factory=list)

    def add(self, parent: int, tag: str, attrs: str, text: str | None) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.feats.append([f"t:{tag}"])
        self.text.append(text)
        self.element.append(tag)
        self.attrs.append(attrs)
        return len(self.parent) - 1


def parse(page: str | None) -> Page:
    """Block elements and text blocks of a page. Broken markup is repaired as browsers do in the common cases; nothing is cut off.

    A silent element without an end tag of its own would swallow the blocks behind it, so the page is parsed again with it as a plain block.
    """
    loud: set[int] = set()
    while (tree := _parse(page, loud)) is None:
        pass
    return tree


def _parse(page: str | None, loud: set[int]) -> Page | None:
    """The tree, with the tags at ``loud`` not silent; None if such tags were found and added."""
    tree = Page()
    root = tree.add(-1, "#root", "", None)
    # all open elements with the block node that they belong to, and the place of the tag if silent
    stack: list[tuple[str, int, int | None]] = [("#root", root, None)]
    opened = {"#root": 1}
    buf: list[str] = []
    links, in_link, silent = 0, 0, 0
    again = False
    endless: set[str] = set()  # raw elements that have no end tag from here on

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(buf).split())
        buf.clear()
        if text:
            node = stack[-1][1]
            k = tree.add(node, "#text", "", text)
            n = len(text)
            f = tree.feats[k]
            f.append(f"n:{min(7, n.bit_length() // 2 if n < 4096 else 7)}")
            f.append(f"l:{min(3, 4 * links // max(1, n))}")
            up = tree.parent[node]
            f.append(f"p:{tree.element[node]}<{tree.element[up] if up >= 0 else ''}")
            f.append(f"e:{int(text[-1] in '.!?:;\"”»…')}")
        links = 0

    def pop(ended: bool = False) -> None:
        nonlocal silent, in_link, again
        tag, _, start = stack.pop()
        opened[tag] -= 1
        silent -= start is not None
        in_link -= tag == "a"
        if start is not None and not ended and tag != "head" and tag not in _RAW:
            loud.add(start)
            again |= not silent

    page = page or ""
    at = 0
    while True:
        lt = page.find("<", at)
        m = None
        while lt >= 0 and not (m := _TAG.match(page, lt)):
            lt = page.find("<", lt + 1)
        raw = page[at : lt if lt >= 0 else len(page)]
        if silent and stack[-1][0] == "head" and raw.strip():
            pop()
        if raw and not silent:
            s = _html.unescape(raw) if "&" in raw else raw
            buf.append(s)
            links += len(s.strip()) * (in_link > 0)
        if lt < 0:
            break
        at = m.end()
        tag = m["t"]
        if tag is None:
            continue
        tag = tag.lower()
        block = tag not in _INLINE
        if silent and stack[-1][0] == "head" and (tag in ("body", "html", "br") if m["e"] else tag not in _HEAD and tag != "head"):
            pop()
        if m["e"]:
            if not opened.get(tag):
                if block and not silent:
                    flush()
                continue
            if tag in _INLINE:
                # an inline end tag doesn't close blocks around it
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        break
                    if stack[k][0] not in _INLINE:
                        k = -1
                        break
                if k < 0:
                    continue
            elif not silent:
                flush()
            while True:
                last = stack[-1][0]
                pop(last == tag)
                if last == tag:
                    break
            continue
        quiet = tag in _SILENT and lt not in loud
        end = None
        if quiet and tag in _RAW:
            end = None if tag in endless else re.compile(f"</{tag}", re.I).search(page, at)
            if end is None:
                endless.add(tag)
            quiet = end is not None or tag in ("script", "style")
        if silent and not quiet:
            continue
        if block:
            flush()
            if opened.get("p") and not quiet:
                while opened["p"] and any(t == "p" for t, _, _ in stack):
                    pop()
            if tag in _CLOSES:
                own, stop = _CLOSES[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in stop:
                        break
                    if stack[k][0] in own:
                        while len(stack) > k:
                            pop()
        if tag == "br":
            buf.append(" ")
        if tag in _VOID or m["a"].endswith("/") and tag in ("svg", "path"):
            continue
        node = stack[-1][1]
        if block and not quiet:
            above = tree.element[node]
            node = tree.add(node, tag, m["a"], None)
            tree.feats[node] = [f"t:{tag}<{above}", *(f"w:{w}" for w in _attr_words(m["a"]))]
        elif not block and m["a"] and (w := _attr_words(m["a"])) and "hidden" in w:
            node = tree.add(node, tag, m["a"], None)
            tree.feats[node] += [f"w:{x}" for x in w]
        stack.append((tag, node, lt if quiet else None))
        opened[tag] = opened.get(tag, 0) + 1
        silent += quiet
        in_link += tag == "a"
        if quiet and tag in _RAW:
            at = end.start() if end else len(page)
    flush()
    while silent:
        pop()
    return None if again else tree


@dataclass
class TreeModel:
    """Log-potentials: ``own`` by feature, ``edge[parent, child]``, ``root``."""

    own: dict[str, np.ndarray]
    edge: np.ndarray
    root: np.ndarray

    def marginals(self, pages: list[Page]) -> list[np.ndarray]:
        """For each page the marginal distributions of its nodes: messages up, then down, all pages level by level."""
        size = [len(p.parent) for p in pages]
        first = np.cumsum([0, *size])
        parent = np.concatenate([np.array(p.parent) + o for p, o in zip(pages, first)])
        depth = np.concatenate([np.array(p.depth) for p in pages])
        zero = np.zeros(3)
        own = np.array([sum((self.own.get(f, zero) for f in fs), zero) for p in pages for fs in p.feats])
        up = own.copy()  # own potential and all messages from below
        sent = np.zeros_like(own)
        order = np.argsort(depth, kind="stable")
        levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
        for who in reversed(levels[1:]):
            x = self.edge[None] + up[who][:, None, :]
            top = x.max(axis=2)
            sent[who] = top + np.log(np.exp(x - top[:, :, None]).sum(axis=2))
            np.add.at(up, parent[who], sent[who])
        down = np.zeros_like(own)
        down[levels[0]] = self.root
        for who in levels[1:]:
            p = parent[who]
            x = (down[p] + up[p] - sent[who])[:, :, None] + self.edge[None]
            top = x.max(axis=1)
            down[who] = top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))
        b = up + down
        b = np.exp(b - b.max(axis=1, keepdims=True))
        b /= b.sum(axis=1, keepdims=True)
        return [b[i:j] for i, j in zip(first[:-1], first[1:])]


def labelled_pages(n: int = FIT_PAGES, seed: int = 11) -> list[str]:
    """Pages of many layouts whose text blocks are marked: those of the article hold the word ``qq``."""
    rng = random.Random(seed)

    def words(a: int, b: int, mark: bool = False, stop: str = "") -> str:
        w = ["".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randint(2, 9))) for _ in range(rng.randint(a, b))]
        return " ".join((["qq"] if mark else []) + w) + stop

    def attr(*names: str) -> str:
        name = rng.choice(names)
        return rng.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {words(1, 1)}"', f' class="{words(1, 1)}-{name}"' if rng.random() < 0.3 else f' class="{name}"'])

    def links(k: int) -> str:
        return "".join(rng.choice(['<li><a href="/x">{}</a></li>', '<li><a href="/x">{}</a>', '<a href="/x">{}</a> ']).format(words(1, 3)) for _ in range(k))

    def menu() -> str:
        return rng.choice([f"<nav><ul>{links(6)}</ul></nav>", f"<nav{attr('navbar', 'menu')}>{links(4)}</nav>", f"<div{attr('menu', 'nav', 'navigation', 'breadcrumb', 'breadcrumbs')}><ul>{links(5)}</ul></div>", f"<ul{attr('menu', 'nav')}>{links(5)}</ul>", f'<div role="navigation">{links(5)}</div>'])

    def ad() -> str:
        t = words(3, 25, stop=".")
        return rng.choice([f"<div{attr('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner')}>{t}</div>", f"<aside{attr('ad', 'promo')}><p>{t}</p></aside>", f"<div{attr('ad-box', 'ad')}><a href='#'>{t}</a></div>", f"<section{attr('sponsor', 'promo')}><p>{t}</p></section>"])

    def notice() -> str:
        t = words(6, 30, stop=".")
        return rng.choice([f"<div{attr('cookie', 'cookie-notice', 'consent', 'notice', 'alert', 'popup')}><p>{t}</p><button>ok</button></div>", f"<div{attr('newsletter', 'subscribe', 'cookie-banner')}>{t}</div>", f'<div role="alert">{t}</div>'])

    def form() -> str:
        return rng.choice([f"<form action='/s'><label>{words(1, 3)}</label><input name=q><button>{words(1, 1)}</button></form>", f"<div{attr('search', 'login', 'signup')}><form><p>{words(2, 9)}</p><input></form></div>", f"<form><p>{words(2, 12)}</p><textarea>{words(2, 4)}</textarea></form>"])

    def side() -> str:
        inner = "".join(rng.choice([f"<h3>{words(1, 4)}</h3><ul>{links(4)}</ul>", f"<p>{words(5, 40, stop='.')}</p>", f"<div>{words(3, 20)}</div>"]) for _ in range(rng.randint(1, 3)))
        return rng.choice([f"<aside>{inner}</aside>", f"<aside{attr('sidebar', 'related')}>{inner}</aside>", f"<div{attr('sidebar', 'related', 'widget', 'recommended', 'rail', 'share', 'social')}>{inner}</div>", f'<div role="complementary">{inner}</div>'])

    def comments() -> str:
        one = "".join(rng.choice([f"<div class='comment'><p>{words(3, 60, stop='.')}</p></div>", f"<li class='comment'><b>{words(1, 2)}</b><p>{words(3, 50, stop='.')}</p></li>", f"<article class='comment'><p>{words(3, 40, stop='!')}</p></article>", f"<p>{words(3, 40, stop='.')}</p>"]) for _ in range(rng.randint(1, 5)))
        return rng.choice([f"<section{attr('comments', 'comment-list', 'responses', 'replies')}><h2>{words(1, 3)}</h2>{one}</section>", f"<div{attr('comments', 'comment', 'disqus')}>{one}</div>", f"<ol{attr('comment-list', 'comments')}>{one}</ol>"])

    def foot() -> str:
        t = f"&copy; {words(2, 12)} &middot; {words(2, 20, stop='.')}"
        return rng.choice([f"<footer>{t}</footer>", f"<footer><p>{t}</p><ul>{links(3)}</ul></footer>", f"<div{attr('footer', 'copyright', 'legal')}>{t}</div>", f'<div role="contentinfo">{t}</div>'])

    def head() -> str:
        return rng.choice([f"<header><a href='/'>{words(1, 3)}</a>{menu()}</header>", f"<header><h2>{words(1, 4)}</h2><p>{words(2, 8)}</p></header>", f"<div{attr('header', 'masthead', 'site-header', 'topbar')}>{words(1, 6)}</div>", f'<div role="banner"><h1>{words(1, 3)}</h1></div>', ""])

    def piece() -> str:
        long = rng.random() < 0.8
        t = words(8, 90, True, ".") if long else words(1, 6, True, rng.choice([".", ""]))
        if rng.random() < 0.2:
            t = t.replace(" ", f" <a href='/y'>{words(1, 2)}</a> ", 1)
        return rng.choice([f"<p>{t}</p>"] * 10 + [f"<p>{t}", f"<h2>{words(2, 8, True)}</h2>", f"<h3>{words(1, 8, True)}</h3>", f"<ul><li>{t}</li><li>{words(2, 20, True)}</li></ul>", f"<ol><li>{t}<li>{words(2, 9, True)}</ol>", f"<blockquote><p>{t}</p></blockquote>", f"<pre>{t}</pre>", f"<table><tr><td>{words(1, 5, True)}</td><td>{words(1, 9, True)}</td></tr></table>", f"<div>{t}</div>", f"<section><h2>{words(1, 5, True)}</h2><p>{t}</p></section>", f"<figure><img src=x><figcaption>{words(2, 12, True)}</figcaption></figure>", f"<p><b>{t}<br>"])

    def article() -> str:
        title = rng.choice([f"<h1>{words(2, 14, True)}</h1>"] * 4 + [f"<header><h1>{words(2, 14, True)}</h1></header>", f"<h1 class='title'>{words(2, 9, True)}</h1>", ""])
        parts = [piece() for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 14, 25]))]
        for extra, chance in ((ad, 0.2), (form, 0.05), (side, 0.08), (notice, 0.05)):
            if rng.random() < chance:
                parts.insert(rng.randint(0, len(parts)), extra())
        body = title + "".join(parts)
        if rng.random() < 0.12:
            body += comments()
        return rng.choice([f"<article>{body}</article>"] * 3 + [f"<main>{body}</main>", f"<main><article>{body}</article></main>", f"<div{attr('content', 'main', 'post', 'entry-content', 'article', 'article-body', 'story', 'text', 'post-body', 'page-content')}>{body}</div>", f"<div{attr('container', 'wrapper', 'page')}><div{attr('content', 'post', 'entry', 'story')}>{body}</div></div>", f'<div role="main">{body}</div>', f"<div>{body}</div>", f"<section{attr('content', 'article')}>{body}</section>"])

    out = []
    for _ in range(n):
        before = [x() for x in (head, menu, ad, notice, form) if rng.random() < 0.5]
        after = [x() for x in (side, comments, ad, form, notice, menu) if rng.random() < 0.35]
        if rng.random() < 0.3:
            before.append(side())
        rng.shuffle(before)
        inner = "".join(before) + article() + "".join(after) + (foot() if rng.random() < 0.85 else "")
        if rng.random() < 0.2:
            inner = f"<div{attr('wrapper', 'container', 'page', 'site')}>{inner}</div>"
        out.append(f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{margin:0}}</style></head><body>{inner}</body></html>"[: None if rng.random() < 0.95 else -14])
    return out


def fit(pages: list[str] | None = None) -> TreeModel:
    """Potentials counted on marked pages (see ``labelled_pages``)."""
    feat: dict[str, np.ndarray] = {}
    edge = np.full((3, 3), SMOOTHING)
    root = np.full(3, SMOOTHING)
    total: dict[str, np.ndarray] = {}
    for text in pages if pages is not None else labelled_pages():
        p = parse(text)
        n = len(p.parent)
        good, all_ = np.zeros(n), np.zeros(n)
        for k in range(n - 1, -1, -1):
            if p.text[k] is not None:
                good[k], all_[k] = float(p.text[k].startswith("qq ") or p.text[k] == "qq"), 1.0
            if p.parent[k] >= 0:
                good[p.parent[k]] += good[k]
                all_[p.parent[k]] += all_[k]
        y = np.where(all_ == 0, OTHER, np.where(good == all_, CONTENT, np.where(good == 0, OTHER, MIXED)))
        for k in range(n):
            for f in p.feats[k]:
                kind = f[0]
                feat.setdefault(f, np.zeros(3))[y[k]] += 1
                total.setdefault(kind, np.zeros(3))[y[k]] += 1
            if p.parent[k] >= 0:
                edge[y[p.parent[k]], y[k]] += 1
            else:
                root[y[k]] += 1
    kinds = {k: sum(f[0] == k for f in feat) for k in total}
    own = {f: (2 if f[0] == "w" else 1) * np.log((c + SMOOTHING) / (total[f[0]] + SMOOTHING * kinds[f[0]])) for f, c in feat.items()}
    # words of attributes are chosen by authors to tell what an element is, so they count twice; a feature never seen says nothing
    return TreeModel(own, np.log(edge / edge.sum(axis=1, keepdims=True)), np.log(root / root.sum()))


def main_text(pages: list[str | None], model: TreeModel) -> list[str]:
    """The main text of each page: its content blocks in order, joined by two newlines."""
    trees = [parse(p) for p in pages]
    out = []
    for t, b in zip(trees, model.marginals(trees)) if trees else ():
        out.append("\n\n".join(x for x, q in zip(t.text, b[:, CONTENT]) if x is not None and q > 0.5))
    return out


def extract(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    A null or empty html has the empty text. n_chars counts code points. Repeated rows get equal results, an empty table
    none.
    """
    spark = pages.sparkSession
    bounded_batches(spark, 256)
    shared = spark.sparkContext.broadcast(model or fit())
    source = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            text = main_text(b.column(2).to_pylist(), m)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = [source.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return source.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
