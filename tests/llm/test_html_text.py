import random
from itertools import product

import numpy as np
import pytest

from basketlens.llm.html_text import FEATURES, MARK, TAG_LINKS, TAGS, Potentials, extract, labelled_pages, main_text, made_page, marginals, parse, train

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav></header>
<div class="cookie-notice">We use cookies on this site. <button>Fine</button></div>
<!-- ad --><div class="ad">Buy this now, it is cheap.</div>
<article><h1>A title &amp; more</h1><p><b>First   words.<br><p>Second&nbsp;block with <a href="/x">a link</a> in
it &lt;here&gt; &#233;.</p><div class="ad">Another offer.</div><ul><li>point one</li><li>point two</li></ul></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/r">Other story</a></li></ul></aside>
<form action="/s"><label>Search</label><input name="q"><button>Go</button></form>
<section id="comments"><div class="comment"><p>I think that this is a long reader comment of several words. It has sentences.</p></div></section>
<footer>&copy; 2020 Somebody. All rights reserved.</footer></body></html>"""


@pytest.fixture(scope="module")
def potentials(spark):
    return train(labelled_pages(spark))


def test_page(potentials):
    assert main_text(PAGE, potentials) == "A title & more\nFirst words.\nSecond block with a link in it <here> é.\npoint one\npoint two"


def test_marginals_are_exact():
    rng = np.random.default_rng(3)
    normal = lambda *shape: rng.normal(size=shape)
    p = Potentials([normal(2, n) for n in FEATURES.values()], normal(4 * len(TAGS), 2, 2), normal(2))
    parents = [-1, 0, 0, 1, 1, 4, 2]
    values = np.stack([rng.integers(0, n, len(parents)) for n in FEATURES.values()], axis=1)
    total, content = 0.0, np.zeros(len(parents))
    for y in product((0, 1), repeat=len(parents)):
        log = p.root[y[0]] + sum(t[a, values[i, f]] for i, a in enumerate(y) for f, t in enumerate(p.seen)) + sum(p.child[values[i, TAG_LINKS] // 4, y[parents[i]], y[i]] for i in range(1, len(parents)))
        total += np.exp(log)
        content += np.exp(log) * np.array(y)
    assert marginals(parents, values, p) == pytest.approx(content / total)


def test_new_layouts(potentials):
    """Words of marked blocks against words found, on pages that the training has not seen."""
    hits = wanted = got = 0
    for i in range(300):
        html = made_page(random.Random(f"test-{i}"), True)
        nodes = parse(html)
        marked = [False] * len(nodes)
        words = set()
        for k, n in enumerate(nodes):
            marked[k] = n.marked or (n.parent >= 0 and marked[n.parent] and n.kind in ("none", "content", "meta"))
            if marked[k]:
                words.update("".join(x for x in n.parts if isinstance(x, str)).split())
        found = set(main_text(html.replace(f" {MARK}", ""), potentials).split())
        hits, wanted, got = hits + len(words & found), wanted + len(words), got + len(found)
    assert hits / wanted > 0.97 and hits / got > 0.97


SENTENCES = "The quick brown fox went over the hill and down to the river. It was a long day for all of them. "
SECTIONS = "".join(f"<section><h2>Part {i}</h2><p>{SENTENCES * 2}</p></section>" for i in range(6))
NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav>'
FOOT = "<footer>&copy; 2020 Somebody. All rights reserved.</footer>"
UNNAMED = {
    "sections in an app root": f'<div id="root">{SECTIONS}</div>',
    "a whole page in an app root": f'<div id="root">{NAV}{SECTIONS}{FOOT}</div>',
    "bare boxes": "".join(f"<div>{SENTENCES * 3}</div>" for _ in range(6)),
    "bare boxes between menu and footer": NAV + "".join(f"<div>{SENTENCES * 3}</div>" for _ in range(6)) + FOOT,
    "bare paragraphs": f"{NAV}<h1>Title</h1><p>{SENTENCES}</p><p>{SENTENCES}</p>{FOOT}",
    "a table": f"<table><tr><td>{NAV}</td><td><h1>Title</h1><p>{SENTENCES}</p><p>{SENTENCES}</p></td></tr></table>",
    "boxes in boxes": f"<div><div>{NAV}</div><div><div><h1>Title</h1><p>{SENTENCES}</p><p>{SENTENCES}</p></div></div><div>{FOOT}</div></div>",
    "names that say nothing": f'{NAV}<div class="x7f"><div class="css-1a2b"><p>{SENTENCES}</p><p>{SENTENCES}</p></div></div>{FOOT}',
    "a notice for lack of scripts": f'<noscript>You need to enable JavaScript to run this app.</noscript><div id="root">{SECTIONS}</div>',
    "the same before an article": f"<noscript><div>Please enable JavaScript.</div></noscript><article><h1>Title</h1><p>{SENTENCES}</p></article>",
}


@pytest.mark.parametrize("layout", UNNAMED)
def test_layouts_without_telling_names(potentials, layout):
    body = UNNAMED[layout]
    text = main_text(f"<html><body>{body}</body></html>", potentials)
    assert text.count("quick brown") == body.count("quick brown") and text.count("Part ") == body.count("Part ") and text.count("Title") == body.count("Title")
    assert not any(word in text for word in ("Home", "About", "Somebody", "JavaScript"))


def test_edge_cases(spark, potentials):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    pages = [
        (1, "u", None), (2, None, ""), (None, "u", "<p>plain words only, and some more of them here"), (4, "u", "no markup at all"), (5, "u", "<article><p>" + "word " * 50000 + "</p></article>"),
        (6, "u", deep), (7, "u", "</p></div><p>after & before &nosuch; &#x110000;"), (8, "u", "<script>unclosed <p>text"), (9, "u", "<article><p>a</article><"), (9, "u", "<article><p>a</article><"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = extract(df.selectExpr("html", "url", "page_id", "1 as text", "2 as HTML"), potentials).collect()
    found = {r.page_id: r.text for r in out}
    assert len(out) == len(pages) and all(r.n_chars == len(r.text) for r in out)
    assert found[1] == found[2] == found[8] == "" and len(found[5].split()) == 50000
    assert extract(df.limit(0), potentials).count() == 0


def test_whole_table(spark, potentials):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r, p in zip(extract(pages, potentials).orderBy("page_id").collect(), pages.orderBy("page_id").collect(), strict=True):
        article = p.html[p.html.index("<article>") : p.html.index("</article>")]
        assert r.text.split() == main_text(f"<article>{article}</article>", potentials).split()
        assert r.text.count("\n") + 1 >= article.count("</p>")


def test_optional_tags_left_out(potentials):
    whole = main_text(PAGE, potentials)
    for gone in (["</head>"], ["</head>", "<body>"], ["</head>", "<body>", "</p>", "</body></html>"], ["<html>", "<head>", "</head>", "<body>"]):
        page = PAGE
        for tag in gone:
            # not the </p> that is in the script
            page = page.replace('"</p>"', "0").replace(tag, "")
        assert main_text(page, potentials) == whole, gone
    head = "<!DOCTYPE html><head><meta charset=utf-8><title>T</title><noscript><link rel=x><style>p{}</style></noscript><template><p>never</p></template>"
    for start in ("<body>", "", "<p>", "<noscript><img src=x></noscript><style>q{}</style>"):
        assert main_text(f"{head}{start}Plain words and some more of them here.", potentials) == "Plain words and some more of them here."


def test_embedded_text_stays(potentials):
    inside = "<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> is <object>the first <b>word</b></object> of <noscript>it all</noscript>, <svg class='share'><path class='menu'/><text>drawn</text></svg> here.<noscript><p>A second block of words.</noscript>"
    assert main_text(f"<article>{inside}<p>The end of it.</article>", potentials) == "So x=2 is the first word of it all, drawn here.\nA second block of words.\nThe end of it."
