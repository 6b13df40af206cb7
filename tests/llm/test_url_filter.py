import pytest

from siftreel.llm.components import components
from siftreel.llm.url_filter import edges_of, url_filter

URLS = {
    "http://a.net/x": ("a.net", "/x", "net/", "block"),
    "https://WWW.Example.NET/en/1?q=/de/": ("www.example.net", "/en/1", "example.net/en/", "allow"),
    "http://example.net/EN/": ("example.net", "/EN/", "net/", "block"),
    "http://net": ("net", "", None, "allow"),
    "http://net/": ("net", "/", "net/", "block"),
    "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
    "http://m.example.com/de/?x": ("m.example.com", "/de/", "example.com/de/", "block"),
    "http://example.com#/de/": ("example.com", "", None, "allow"),
    "ftp://b.org/fr/://c.net/": ("b.org", "/fr/://c.net/", "org/fr/", "allow"),
    "no url": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    "http://": ("", "", None, "allow"),
    "http://x.net:80/": ("x.net:80", "/", None, "allow"),
    "http://É.net/\nq": ("É.net", "/\nq", "net/", "block"),
}


def test_rules(spark):
    df = spark.createDataFrame([*[(i, u, "h") for i, u in enumerate(URLS)], (99, None, "h"), (0, "http://a.net/x", "h")], "page_id long, url string, host string")
    got = url_filter(df)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    rows = got.collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == URLS.get(r["url"], ("", "", None, "allow"))
    assert url_filter(df.limit(0)).collect() == []


def test_classes(spark):
    """A blocked url blocks what is equivalent to it; an allow rule holds for the url it fits."""
    pages = [
        (1, "http://one.org/a", '<head><link rel="canonical" href="http://bad.net/x"></head>'),
        (2, "http://two.org/a", "<meta HTTP-EQUIV=refresh content='0; url=http://one.org/a'>"),
        (3, "http://two.org/fr/a", '<link href=http://two.org/a rel=canonical>'),
        (4, "http://four.org/a", '<link rel="canonical" href="http://five.org/a?x=1&amp;y=2"><link rel=stylesheet href="http://bad.net/x">'),
        (5, "http://five.org/a?x=1&y=2", None),
        (6, "http://six.org/", '<a href="http://bad.net/x">'),
        (7, None, '<link rel="canonical" href="http://bad.net/x">'),
        (8, "http://bad.net/x", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert edges_of(df).count() == 4
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter(df, edges_of(df)).collect()}
    assert got == {1: (None, "block"), 2: (None, "block"), 3: ("org/fr/", "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: ("net/", "block")}


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(39 - i, 40 - i) for i in range(30)], [(3, 3), (None, 2), (5, 4), (4, 5), (7, 5), (10, 11)], [], [((i * 37) % 101, (i * 53) % 101) for i in range(90)]])
def test_components(spark, edges):
    root = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a in root and b in root:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = [tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert sorted(got) == sorted((x, find(x)) for x in root)


def test_long_tags(spark):
    """However long its attributes are, a tag names its target."""
    html = f'<link rel="canonical" data-x="{"y" * 100_000}" href="http://bad.net/x">'
    df = spark.createDataFrame([(1, "http://one.org/a", html)], "page_id long, url string, html string")
    assert [tuple(r) for r in edges_of(df).collect()] == [("http://one.org/a", "http://bad.net/x")]
    assert url_filter(df, edges_of(df)).first()["verdict"] == "block"


TARGETS = {
    '<link rel="canonical" href="http://bad.net/x">': "http://bad.net/x",
    "<LINK HREF='http://BAD.net/x#frag' title='a > b' REL='alternate canonical'>": "http://bad.net/x",
    '<link title="a > b" rel=canonical href=http://bad.net/x>': "http://bad.net/x",
    '<link rel="canonical" href="//bad.net/x?a=1&amp;b=2">': "http://bad.net/x?a=1&b=2",
    '<link rel="canonical" href="/y">': "http://one.org/y",
    '<link rel="canonical" href="y/z">': "http://one.org/d/y/z",
    '<link rel="canonical" href="../y/./z/..">': "http://one.org/y/",
    '<link rel="canonical" href="?q=2">': "http://one.org/d/p?q=2",
    '<link rel="canonical" href="http&#58;&#x2F;&#47;bad.net/&quot;">': 'http://bad.net/"',
    "<meta http-equiv='Refresh' content='5;URL=\"http://bad.net/x\"'>": "http://bad.net/x",
    '<meta content="0, url = /y" http-equiv=refresh />': "http://one.org/y",
    '<meta http-equiv="refresh" content="30">': None,
    '<link rel="canonical-ish" href="http://bad.net/x">': None,
    '<link data-rel="canonical" href="http://bad.net/x">': None,
    '<!-- <link rel="canonical" href="http://bad.net/x"> -->': None,
    '<link rel="canonical" href="mailto:a@bad.net">': None,
    '<link rel="canonical" href="#top">': None,
    '<link rel="canonical" href="HTTP://One.org/d/p?q=1">': None,
    '<link rel="canonical" href="">': None,
    "<a rel=canonical href=http://bad.net/x>": None,
}


def test_targets(spark):
    """Each way to name a target, against what a browser would make of it."""
    df = spark.createDataFrame([(i, "http://One.org/d/p?q=1#f", f"<head>{t}</head>") for i, t in enumerate(TARGETS)], "page_id long, url string, html string")
    for i, want in enumerate(TARGETS.values()):
        got = [tuple(r) for r in edges_of(df.where(f"page_id = {i}")).collect()]
        assert got == ([("http://one.org/d/p?q=1", want)] if want else []), (i, got)


def test_sql_on_targets(spark, tmp_path):
    import duckdb

    from siftreel.llm.queries import ORACLES, QUERIES

    pages = [(i, f"http://h{i}.org/d/p#f", f"<head>{t}</head>") for i, t in enumerate(TARGETS)]
    pages += [(100, "http://H4.org/y", None), (101, "http://h5.org/d/y/z", '<link rel=canonical href="http://bad.net/">'), (102, "http://h6.org/fr/x", '<link rel=canonical href="/y/">'), (103, "http://h7.org/d/p?q=2", '<meta http-equiv=refresh content="0;url=//a.example.com/de/">')]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(ORACLES["op4_url_filter"])
    columns = [x[0] for x in want.description]
    rows = sorted(map(str, want.fetchall()))
    assert rows == sorted(str(tuple(r)) for r in QUERIES["op4_url_filter"](spark, str(tmp_path)).select(*columns).collect())
    assert sum("'block'" in r for r in rows) == 10  # 0-3, 5, 7-9, 101, 103
