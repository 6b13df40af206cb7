from itertools import product

import numpy as np
import pytest

from siftreel.llm.html_text import blocks_of, extract, main_text, min_cut, network

LONG = "This is a paragraph of the article that is long enough to be taken for content by itself."
AROUND = {
    "nav": "<nav><ul><li><a href=/>Home page</a></li></ul></nav>",
    "header": f"<header><div>Site name</div><p>{LONG}</p></header>",
    "footer": f"<footer><p>{LONG}</p>&copy; 2024</footer>",
    "aside": f"<aside><p>{LONG}</p></aside>",
    "sidebar": f'<div id="sidebar"><p>{LONG}</p></div>',
    "cookies": f'<div class="cookie-notice"><p>{LONG}</p><button>Yes</button></div>',
    "ad": f'<div class="ad">{LONG}</div>',
    "adBanner": f'<section class="topAdBanner">{LONG}</section>',
    "form": f"<form><label>{LONG}</label><input><textarea>{LONG}</textarea></form>",
    "script": f"<script>var a = '<p>{LONG}</p>';</script><style>p {{}}</style><!-- <p>{LONG}</p> --><noscript>{LONG}</noscript>",
    "comments": f'<section class="comments"><h2>Comments</h2><article class="comment"><p>{LONG}</p></article></section>',
    "role": f'<div role="navigation"><p>{LONG}</p></div>',
    "hidden": f"<div hidden><p>{LONG}</p></div><p style='display: none'>{LONG}</p>",
}
BODY = f"<h1>The title</h1><p>{LONG}<p>Short &amp; <b>bold<br>one</b>.</p><ul><li>item &#233;</ul>"
WANT = f"The title\n\n{LONG}\n\nShort & bold one.\n\nitem é"


@pytest.mark.parametrize("kind", AROUND)
@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", '<div class="post-content">%s</div>'])
def test_around(kind, wrap):
    x = AROUND[kind]
    page = f"<html><head><title>No</title></head><body class='with-sidebar'>{x}{wrap % BODY}{x}</body></html>"
    assert main_text(page) == WANT
    if kind != "header":
        assert main_text(f"<body>{wrap % (BODY + x)}</body>") == WANT


def test_without_markup_of_parts():
    page = f"<div><h2>A heading</h2><p>{LONG}</p><p>Tiny.</p><p>{LONG}</p></div><ul><li><a href=1>Home</a></li><li><a href=2>About us</a></li></ul><p>Copyright 2020 by X</p>"
    assert main_text(page) == f"A heading\n\n{LONG}\n\nTiny.\n\n{LONG}"


def test_classes_of_states():
    page = f'<div class="layout has-sidebar"><article class="post comments-open no-ads">{BODY}</article></div>'
    assert main_text(page) == WANT


@pytest.mark.parametrize("page, want", [(None, ""), ("", ""), ("plain", "plain"), ("a < b", "a < b"), ("<p>x", "x"), ("</p></div>x", "x"), ("<p>a &lt;b&gt; &nbsp; c</p>", "a <b> c"), ("<p>a</p", "a"), ("<script>no", ""), ("<!-- no", ""), ("<b><p>x</b>y</p>", "xy"), ("<p title='>'>x</p>", "x"), ("<p title=\">x</p>", "x")])
def test_odd(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("seed", range(40))
def test_generated_pages(seed):
    """Pages put together from an article, whose text is known, and parts of all kinds around and within it."""
    r = np.random.default_rng(seed)
    words = lambda n: " ".join("".join(r.choice(list("aeioubdklmnrst"), int(r.integers(2, 9)))) for _ in range(n))
    kept = [("h1", words(int(r.integers(1, 6))))]
    for _ in range(int(r.integers(1, 12))):
        kind = str(r.choice(["p", "p", "p", "h2", "li", "blockquote"]))
        kept.append((kind, words(int(r.integers(1, 60))) + "." * (kind == "p")))
    parts = [x for k, x in AROUND.items() if k != "header"]
    inner = ""
    for kind, text in kept:
        inner += f"<ul><li>{text}</li></ul>" if kind == "li" else f"<{kind}>{text}</{kind}>"
        if r.random() < 0.2:
            inner += str(r.choice(parts))
    wrap = str(r.choice(["<article>%s</article>", "<main><div>%s</div></main>", '<div class="layout"><article class="post">%s</article></div>']))
    menu = "<nav><ul>" + "".join(f'<li><a href="/">{words(2)}</a></li>' for _ in range(int(r.integers(1, 9)))) + "</ul></nav>"
    around = [str(x) for x in r.choice([*AROUND.values()], 3)]
    page = f"<html><body>{around[0]}{menu}{around[1]}{wrap % inner}{around[2]}<footer>{words(30)}</footer></body></html>"
    assert main_text(page) == "\n\n".join(t for _, t in kept)


def test_cut_mends_what_costs_get_wrong():
    """Short blocks of an article look like boilerplate, a long one of an advert like content: the cut decides by their surroundings."""
    page = f'<article><h1>T</h1><p>{LONG}</p><p>No.</p><p>{LONG}</p></article><div class="ad"><p>{LONG}</p></div>'
    costs, edges = network(blocks_of(page))
    assert [c > 0 for c in costs[:5]] == [False, True, False, True, True]
    assert min_cut(costs, edges)[:5] == [True, True, True, True, False]


@pytest.mark.parametrize("name", ["legal", "form", "widget", "disclaimer", "search-result"])
def test_words_that_only_hint(name):
    """A class word that doesn't name a part of the page deletes no paragraph."""
    assert main_text(f'<div class="{name}"><p>{LONG}</p></div>') == LONG
    assert main_text(f'<article><p>{LONG}</p><section class="{name}"><p>Roses are red,</p><p>violets are blue,</p></section></article>') == f"{LONG}\n\nRoses are red,\n\nviolets are blue,"
    assert main_text(f'<form id="page"><h1>A title</h1><p>{LONG}</p><p>{LONG}</p></form>') == f"A title\n\n{LONG}\n\n{LONG}"


def test_min_cut_is_least():
    r = np.random.default_rng(3)
    for _ in range(150):
        n = int(r.integers(1, 9))
        costs = [float(x) for x in r.normal(0, 1, n).round(2)]
        edges = [(i, j, round(float(r.uniform(0, 1.5)), 2)) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5]
        price = lambda y: sum(max(0, c) * (not v) + max(0, -c) * v for c, v in zip(costs, y, strict=True)) + sum(w for a, b, w in edges if y[a] != y[b])  # noqa: E731, B023
        assert price(min_cut(costs, edges)) == pytest.approx(min(price(y) for y in product([False, True], repeat=n)))


def test_rows(spark):
    big = "<article>" + f"<p>{LONG}</p>" * 5_000 + "</article>"
    df = spark.createDataFrame([(1, "u", f"<p>{LONG}</p>", "t"), (2, None, None, "t"), (None, "u", "", "t"), (1, "u", f"<p>{LONG}</p>", "t"), (3, "v", big, "t")], "page_id long, url string, html string, text string")
    got = extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == sorted([(1, "u", LONG, len(LONG)), (1, "u", LONG, len(LONG)), (2, None, "", 0), (None, "u", "", 0), (3, "v", "\n\n".join([LONG] * 5_000), 5_000 * (len(LONG) + 2) - 2)], key=str)
    assert extract(df.limit(0)).collect() == []
