"""Main text of HTML pages by a tree-structured graphical model.

The block elements of a page are the nodes of a tree.  Each node is content
or not.  A node's label has a potential from what can be seen of it (its tag,
words in its class and id, share of text in links, amount of text, place in
the page), and each child's label one from its parent's label.  Messages are
passed up and down the tree (sum-product), which gives each node's exact
marginal; text of nodes whose marginal is at least one half is the main text.

The tables of the potentials are counted on labelled pages: HTML in which
content elements carry ``data-content``.  ``labelled_pages`` makes a bounded
set of them (``LABELLED_PAGES``) in many layouts, also those whose article is
in bare boxes, paragraphs or table cells without a telling tag or name; own
pages may be given.  A ``noscript`` between blocks is a block of its own,
judged as any other; in a paragraph it is part of the paragraph.

Scripts, styles, templates, head (with its title) and comments never give
text; all else may.  A head without its end tag ends where something starts
that may not stand in a head: an element or plain text.  Character references
are decoded; white space inside a block becomes one space; blocks are joined
by newlines in page order.

Nulls: a null html is empty, and an empty page has empty text; other nulls
stay.  Repeated rows are extracted each.  An empty table gives no rows.  Ties: a
marginal of exactly one half is content.  Extra columns and columns whose names
differ in case only are left out.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from basketlens.llm.runtime import lean_map, pick, ship

LABELLED_PAGES = 1200
MARK = "data-content"

# Fixed values of HTML: elements without an end, without text, and blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style head template title".split())
# What may stand in an open head; the start of anything else ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript template noframes".split())
FOREIGN = frozenset("svg math".split())  # "/>" ends any element in these
EMBEDS = FOREIGN | frozenset("noscript iframe object canvas audio video".split())  # may hold text and blocks
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "legend li main menu nav noscript ol p pre search section summary table tbody td tfoot th thead tr ul button select textarea label option".split()
)
# A start of the key ends an open element of the value, unless one of its bounds is nearer.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"),
}
BOUNDS = frozenset("ul ol dl table select article section div aside body html".split())
ENDS_P = BLOCKS - frozenset("html body td th tr tbody thead tfoot button select option label legend caption noscript".split())

HOLD_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre summary legend figcaption label".split())

# Kinds of words in class, id and role, the first that fits.
KEYWORDS = [
    ("comment", r"comment|repl(y|ies)|disqus|respond|discussion|reader"),
    ("advert", r"\bads?\b|\bad[-_]|[-_]ads?\b|advert|sponsor|promo|banner|doubleclick"),
    ("notice", r"cookie|consent|notice|gdpr|alert|popup|modal|overlay|paywall|subscribe|newsletter|signup"),
    ("menu", r"\bnav|menu|breadcrumb|pagination|pager|tabs?\b|toolbar|skip"),
    ("side", r"side|widget|related|recommend|popular|trending|more-?(from|stories)|also|tags?\b"),
    ("share", r"share|social|follow"),
    ("foot", r"foot|copyright|colophon|legal"),
    ("head", r"head|masthead|logo|brand|top-?bar|site-?title"),
    ("form", r"form|search|login|input"),
    ("meta", r"meta|byline|author|date|caption|credit"),
    ("content", r"article|content|post|entry|main|story|body|text|page"),
]
_KEYWORDS = [(name, re.compile(pattern)) for name, pattern in KEYWORDS]
_ROLES = {"navigation": "menu", "banner": "head", "contentinfo": "foot", "complementary": "side", "search": "form", "main": "content", "article": "content", "dialog": "notice", "alert": "notice"}
_SPACES = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    kind: str
    parent: int
    marked: bool
    parts: list = field(default_factory=list)  # text, or a child's number
    own: int = 0  # characters of its own text
    linked: int = 0  # of them, in links
    total: int = 0  # characters of its own and its children's text
    total_linked: int = 0


def keyword(attributes: list) -> str:
    """Kind of an element by its class, id and role."""
    words, role = "", ""
    for name, value in attributes:
        if name in ("class", "id"):
            words += " " + (value or "").lower()
        elif name == "role":
            role = (value or "").lower()
    if role in _ROLES:
        return _ROLES[role]
    for name, pattern in _KEYWORDS:
        if words and pattern.search(words):
            return name
    return "none"


class Tree(HTMLParser):
    """Blocks of a page, parents before children; other elements only end and begin."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("html", "none", -1, False)]
        self.open: list[tuple[str, int]] = []  # (tag, node, or -1 for what is no block)
        self.silent = self.links = self.foreign = 0
        self.at = 0
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.silent and tag not in IN_HEAD:
            self._end({"head"}, frozenset({"template"}))
        if tag in VOID:
            self._text(" ")
            return
        if tag in ENDS_P:
            self._end({"p"}, BOUNDS | {"td", "th", "li", "button"})
        if tag in ENDS:
            self._end(set(ENDS[tag]), BOUNDS)
        self.silent += tag in SILENT
        self.links += tag == "a"
        self.foreign += tag in FOREIGN
        kind = keyword(attrs)
        block = tag in BLOCKS and (tag != "noscript" or self.nodes[self.at].tag not in HOLD_TEXT)
        node = -1
        # an inline element that is called an advert or the like is a block of its own
        if not self.silent and (block or (kind not in ("none", "content", "meta", "head") and not self.foreign)) and tag not in ("html", "body", "a"):
            node = len(self.nodes)
            self.nodes.append(Node(tag, kind, self.at, any(a == MARK for a, _ in attrs)))
            self.nodes[self.at].parts.append(node)
            self.at = node
        self.open.append((tag, node))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and (self.foreign or tag in SILENT | EMBEDS | {"a"}):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or tag in ("html", "body"):
            return
        if tag in BLOCKS | SILENT | EMBEDS:
            self._end({tag}, frozenset())
        else:  # an inline end does not end a block
            self._end({tag}, BLOCKS)

    def _end(self, tags: set[str], bounds: frozenset) -> None:
        """Close the nearest open element of these tags, and what is in it, unless a bound is nearer."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in tags:
                for tag, node in self.open[k:]:
                    self.silent -= tag in SILENT
                    self.links -= tag == "a"
                    self.foreign -= tag in FOREIGN
                    if node >= 0:
                        self.at = min(self.at, self.nodes[node].parent)
                del self.open[k:]
                return
            if self.open[k][0] in bounds:
                return

    def handle_data(self, data: str) -> None:
        if self.silent and self.open[-1][0] in ("head", "noscript") and data.strip():
            self._end({"head"}, frozenset({"template"}))
        if not self.silent:
            self._text(data)

    def _text(self, data: str) -> None:
        node = self.nodes[self.at]
        node.parts.append(data)
        size = len(data.strip())
        node.own += size
        node.linked += size * bool(self.links)


def parse(html: str | None) -> list[Node]:
    nodes = Tree(html or "").nodes
    for node in reversed(nodes):
        node.total += node.own
        node.total_linked += node.linked
        if node.parent >= 0:
            nodes[node.parent].total += node.total
            nodes[node.parent].total_linked += node.total_linked
    return nodes


TAGS = ("html", "p", "heading", "li", "list", "div", "article", "main", "section", "nav", "header", "footer", "aside", "form", "table", "quote", "figure", "noscript", "other")
_TAG = {f"h{k}": "heading" for k in range(1, 7)} | {"ul": "list", "ol": "list", "dl": "list", "dt": "li", "dd": "li", "menu": "nav", "blockquote": "quote", "pre": "quote", "figcaption": "figure"}
_TAG |= dict.fromkeys("table tbody thead tfoot tr td th".split(), "table") | dict.fromkeys("button select textarea label option fieldset legend search input".split(), "form")
KINDS = ("none", *(name for name, _ in KEYWORDS))
FEATURES = {"tag_links": 16 * len(TAGS), "kind": len(KINDS), "size": 5, "place": 4}
TAG_LINKS = 0  # the feature of the tag, by which a child's label depends on its parent's
TELLING = frozenset(KINDS) - {"none", "content", "meta"}  # names that boilerplate has
AROUND = frozenset("nav header footer aside form noscript".split())  # tags that it has


def seen(nodes: list[Node]) -> np.ndarray:
    """What is seen of each node: a value for each of FEATURES."""
    out = np.zeros((len(nodes), len(FEATURES)), dtype=np.int64)
    whole, before = max(1, nodes[0].total), 0
    around = [n.kind in TELLING or _TAG.get(n.tag, n.tag) in AROUND for n in nodes]
    for i, n in enumerate(nodes):
        tag = _TAG.get(n.tag, n.tag)
        share = n.total_linked / n.total if n.total else 0.0
        out[i] = (
            16 * (TAGS.index(tag) if tag in TAGS else len(TAGS) - 1) + 8 * (n.kind in TELLING) + 4 * (n.parent >= 0 and around[n.parent]) + (0 if share < 0.05 else 1 if share < 0.3 else 2 if share < 0.8 else 3),
            KINDS.index(n.kind),
            0 if not n.total else 1 if n.total < 25 else 2 if n.total < 100 else 3 if n.total < 400 else 4,
            min(3, 4 * before // whole),
        )
        before += n.own
    return out


@dataclass
class Potentials:
    """Log potentials: of a label with each value seen, of a child's label (by its tag, whether its own name is telling or its parent's name or tag is, and the parent's label), of the root's."""

    seen: list[np.ndarray]
    child: np.ndarray
    root: np.ndarray


def labels(nodes: list[Node]) -> np.ndarray:
    """Whether most text of a labelled node is inside marked elements (without text: as its parent)."""
    inside, marked = np.zeros(len(nodes)), np.zeros(len(nodes), dtype=bool)
    for i, n in enumerate(nodes):
        marked[i] = n.marked or (n.parent >= 0 and marked[n.parent] and n.kind in ("none", "content", "meta"))
        inside[i] = n.own * marked[i]
    for i in range(len(nodes) - 1, 0, -1):
        inside[nodes[i].parent] += inside[i]
    out = np.zeros(len(nodes), dtype=np.int64)
    for i, n in enumerate(nodes):
        out[i] = inside[i] * 2 >= n.total if n.total else out[n.parent] if n.parent >= 0 else 0
    return out


def _count_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for html in batch["html"].to_pylist():
            nodes = parse(html)
            label, values = labels(nodes), seen(nodes)
            rows += [(0, 0, 0, int(label[0]))]
            rows += [(1, int(v[TAG_LINKS]) // 4, int(label[n.parent]), int(y)) for n, v, y in zip(nodes[1:], values[1:], label[1:], strict=True)]
            rows += [(2 + f, int(v), 0, int(y)) for row, y in zip(values, label, strict=True) for f, v in enumerate(row)]
        table, value, parent, label = zip(*rows, strict=True) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in (table, value, parent, label)], names=["t", "value", "parent", "label"])


def train(pages: DataFrame) -> Potentials:
    """Potentials from labelled pages (html), as counts plus one half."""
    ship(pages.sparkSession)
    counted = pick(pages, "html").mapInArrow(lean_map(_count_labels), "t int, value int, parent int, label int")
    root, child = np.full(2, 0.5), np.full((4 * len(TAGS), 2, 2), 0.5)
    tables = [np.full((2, n), 0.5) for n in FEATURES.values()]
    for t, value, parent, label, n in counted.groupBy("t", "value", "parent", "label").count().collect():
        if t == 0:
            root[label] += n
        elif t == 1:
            child[value, parent, label] += n
        else:
            tables[t - 2][label, value] += n
    return Potentials([np.log(x / x.sum(1, keepdims=True)) for x in tables], np.log(child / child.sum(2, keepdims=True)), np.log(root / root.sum()))


def marginals(parents: list[int], values: np.ndarray, p: Potentials) -> np.ndarray:
    """Probability that each node is content, by messages up and down the tree (parents come first)."""
    own = sum(table[:, values[:, f]] for f, table in enumerate(p.seen)).T
    own[0] += p.root
    up, message = own.tolist(), [[0.0, 0.0]] * len(parents)
    tables = p.child[values[:, TAG_LINKS] // 4].tolist()
    for i in range(len(parents) - 1, 0, -1):
        a, b = up[i]
        (c00, c01), (c10, c11) = tables[i]
        message[i] = m = [_add(c00 + a, c01 + b), _add(c10 + a, c11 + b)]
        parent = up[parents[i]]
        parent[0] += m[0]
        parent[1] += m[1]
    belief = [up[0]] + [[0.0, 0.0]] * (len(parents) - 1)
    for i in range(1, len(parents)):
        a, b = belief[parents[i]]
        a, b = a - message[i][0], b - message[i][1]  # the parent without this child
        (c00, c01), (c10, c11) = tables[i]
        belief[i] = [up[i][0] + _add(c00 + a, c10 + b), up[i][1] + _add(c01 + a, c11 + b)]
    both = np.array(belief)
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def main_text(html: str | None, p: Potentials) -> str:
    nodes = parse(html)
    if not nodes[0].total:
        return ""
    content = marginals([n.parent for n in nodes], seen(nodes), p) >= 0.5
    blocks: list[str] = []
    held: list[str] = []

    def end() -> None:
        text = _SPACES.sub(" ", "".join(held)).strip()
        held.clear()
        if text:
            blocks.append(text)

    stack = [(0, iter(nodes[0].parts))]
    while stack:
        i, parts = stack[-1]
        part = next(parts, None)
        if part is None:
            end()
            stack.pop()
        elif isinstance(part, int):
            if nodes[part].tag == "noscript" and not nodes[part].total:
                continue  # an image for lack of scripts: the text goes on
            end()
            stack.append((part, iter(nodes[part].parts)))
        elif content[i]:
            held.append(part)
    return "\n".join(blocks)


def _extract(potentials):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = potentials.value
        for batch in batches:
            texts = [main_text(h, p) for h in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, potentials: Potentials) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    spark = pages.sparkSession
    ship(spark)
    rows = pick(pages, "page_id", "url", "html")
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(lean_map(_extract(spark.sparkContext.broadcast(potentials))), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def labelled_pages(spark: SparkSession, n: int = LABELLED_PAGES, seed: int = 5) -> DataFrame:
    """(html) of n made-up pages in many layouts, content elements marked."""
    return spark.createDataFrame([(made_page(random.Random(f"{seed}-{i}"), True),) for i in range(n)], "html string")


def made_page(r: random.Random, marked: bool) -> str:
    """A page of a random layout: semantic tags or named boxes, with what sites put around an article."""
    mark = f" {MARK}" if marked else ""
    word = lambda: "".join(r.choice("aeioubcdlmnprst") for _ in range(r.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    line = lambda: words(4, 14).capitalize() + "."
    text = lambda: " ".join(line() for _ in range(r.choice([1, 1, 2, 3, 5, 9])))
    link = lambda a=1, b=3: f'<a href="/{word()}">{words(a, b)}</a>'
    items = lambda a, b, m: "<ul>" + "".join(f"<li>{m()}</li>" for _ in range(r.randint(a, b))) + "</ul>"
    named = lambda tag, names: r.choice([f"<{tag}>", f'<{tag} class="{r.choice(names)}">', f'<{tag} id="{r.choice(names)}">'])

    def box(tag: str, names: list[str], inside: str) -> str:
        """A semantic element, or a div with a telling name."""
        if r.random() < 0.6:
            return f"{named(tag, names)}{inside}</{tag}>"
        return f'<div {r.choice(["class", "id"])}="{r.choice(names)}">{inside}</div>'

    def div(names: list[str], inside: str) -> str:
        return f'<{(t := r.choice(["div", "div", "section"]))} {r.choice(["class", "id"])}="{r.choice(names)}">{inside}</{t}>'

    def paragraph() -> str:
        inside = text()
        if r.random() < 0.2:
            inside += " " + link() + " " + line()
        if r.random() < 0.2:
            inside = f"<b>{line()}</b> " + inside
        if r.random() < 0.15:
            inside = f"<b>{line()}<br>"
        return f"<p>{inside}</p>" if r.random() < 0.8 else f"<p>{inside}"

    def article() -> str:
        inside = [f"<h1>{words(2, 10).capitalize()}</h1>"] * (r.random() < 0.8)
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 12])):
            kind = r.random()
            if kind < 0.78:
                inside.append(paragraph())
            elif kind < 0.86:
                inside.append(f"<h2>{words(2, 6).capitalize()}</h2>")
            elif kind < 0.91:
                inside.append(items(2, 6, line))
            elif kind < 0.94:
                inside.append(f"<blockquote><p>{text()}</p></blockquote>")
            elif kind < 0.96:
                inside.append(f"<pre>{words(5, 30)}</pre>")
            elif kind < 0.98:
                inside.append("<table>" + "".join(f"<tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>")
            else:
                inside.append(advert())
        body = "".join(inside)
        kind = r.random()
        if kind < 0.35:
            return f"<article{mark}>{body}</article>"
        if kind < 0.42:
            return f"<main{mark}>{body}</main>"
        if kind < 0.5:
            return f"<main><article{mark}>{body}</article></main>"
        if kind < 0.65:
            return f'<div class="{r.choice(["content", "post", "entry-content", "article-body", "main-text", "story"])}"{mark}>{body}</div>'
        return unnamed(inside, body)

    def unnamed(inside: list[str], body: str) -> str:
        """The article in elements that do not tell what they are."""
        t, outer = r.choice(["div", "div", "section"]), r.choice(["", "", "<div>", "<div><div>"])
        close = "</div>" * outer.count("<div>")
        own = lambda block: re.sub(r"^<(p|h1|h2|ul|blockquote|pre|table)>", rf"<\1{mark}>", block)
        kind = r.random()
        if kind < 0.3:
            return f"{outer}<{t}{mark}>{body}</{t}>{close}"
        if kind < 0.55:  # a box for each part
            parts = [f"<{t}{mark}>" + f"<h2>{words(2, 6).capitalize()}</h2>" * r.randint(0, 1) + f"<p>{text()}</p>" * r.randint(1, 2) + f"</{t}>" for _ in range(r.randint(1, 7))]
            return outer + "".join(parts) + close
        if kind < 0.75:  # boxes of plain text
            return outer + "".join(f"<div{mark}>{text()}</div>" for _ in range(r.randint(1, 8))) + close
        if kind < 0.9:
            return outer + "".join(map(own, inside)) + close
        cells = [f"<td>{items(2, 6, link)}</td>" * r.randint(0, 1), f"<td{mark}>{body}</td>"]
        return f"{outer}<table><tr>{''.join(cells)}</tr></table>{close}"

    def advert() -> str:
        return div(["ad", "ads", "advert", "advertisement", "sponsored", "ad-slot", "promo", "banner-ad"], r.choice([line(), f"<p>{text()}</p>", text(), link(2, 6)]))

    def comments() -> str:
        one = lambda: div(["comment", "comment-body", "reply"], f"<p>{text()}</p>" if r.random() < 0.7 else f"<b>{word()}</b> {text()}")
        return div(["comments", "comment-list", "reader-comments", "replies"], f"<h3>{words(1, 2)}</h3>" * (r.random() < 0.5) + "".join(one() for _ in range(r.randint(1, 5))))

    def menu() -> str:
        return box("nav", ["nav", "menu", "main-menu", "navbar", "breadcrumbs"], r.choice([items(3, 9, link), " ".join(link() for _ in range(r.randint(3, 8)))]))

    def header() -> str:
        return box("header", ["header", "site-header", "masthead", "top-bar"], f"<{(t := r.choice(['h1', 'h2', 'p', 'div']))}>{words(1, 4)}</{t}>" + (menu() if r.random() < 0.5 else "") + (f"<p>{line()}</p>" if r.random() < 0.4 else ""))

    def side() -> str:
        return box("aside", ["sidebar", "side", "widget", "related", "recommended"], f"<h3>{words(1, 3)}</h3>" * r.randint(0, 1) + r.choice([items(2, 6, link), f"<p>{text()}</p>", items(2, 5, line), text()]))

    def notice() -> str:
        return div(["cookie-notice", "notice", "cookie-banner", "consent", "alert", "newsletter", "popup"], r.choice([text(), f"<p>{text()}</p>", f"<p>{line()}</p><button>{word()}</button>"]))

    def form() -> str:
        return f'<form action="/{word()}"><label>{words(1, 3)}</label><input type="text">' + f"<p>{line()}</p>" * r.randint(0, 1) + f"<select><option>{word()}</option><option>{word()}</option></select>" * r.randint(0, 1) + f"<button>{words(1, 2)}</button></form>"

    def footer() -> str:
        return box("footer", ["footer", "site-footer", "copyright", "legal"], r.choice([f"&copy; {words(1, 3)} &middot; {line()}", f"<p>{text()}</p>", items(2, 6, link) + f"<p>{line()}</p>"]))

    def share() -> str:
        return div(["share", "social", "share-buttons"], r.choice([items(2, 4, link), link() + link()]))

    def without_scripts() -> str:
        return f"<noscript>{r.choice([line(), f'<p>{line()}</p>', f'<div>{line()}</div>'])}</noscript>"

    before = [f() for f, p in ((without_scripts, 0.15), (header, 0.6), (notice, 0.3), (menu, 0.7), (form, 0.15), (advert, 0.5), (side, 0.2)) if r.random() < p]
    after = [f() for f, p in ((share, 0.2), (form, 0.2), (side, 0.4), (advert, 0.2), (comments, 0.4), (notice, 0.2), (footer, 0.85)) if r.random() < p]
    if r.random() < 0.3:
        r.shuffle(before)
    if r.random() < 0.15:  # nothing around it
        before, after = before[: r.randint(0, 1)], []
    body = "".join([*before, article(), *after])
    if r.random() < 0.4:
        body = f'<div {r.choice(["class", "id"])}="{r.choice(["page", "wrapper", "container", "site", "root", "app", "__next", "layout"])}">{body}</div>'
    return f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><style>p{{margin:0}}</style></head><body>{body}<script>var t = '{word()}</p>';</script></body></html>"
