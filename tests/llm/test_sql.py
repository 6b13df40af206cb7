"""The queries' SQL, on small tables with everything odd in them."""

import duckdb
import pytest

from siftreel.llm.queries import ORACLES, QUERIES

PAGES = [
    (1, "http://one.org/a", '<head><link rel="canonical" href="http://bad.net/x"></head>'), (2, "http://two.org/a", "<meta HTTP-EQUIV=refresh content='0; url=http://one.org/a'>"), (3, "http://two.org/fr/a", "<link href=http://two.org/a rel=canonical>"),
    (4, "http://four.org/a", '<link rel="canonical" href="http://five.org/a?x=1&amp;y=2">'), (5, "http://five.org/a?x=1&y=2", None), (7, None, '<link rel="canonical" href="http://bad.net/x">'), (8, "http://Bad.NET/x", ""), (8, "http://Bad.NET/x", ""), (9, "none", ""),
    (10, "http://example.net/en/", ""), (11, "http://a.example.com/de/?q", ""),
]
NAN, INF = float("nan"), float("inf")
VECTORS = [(i * 50, [1.0 + i % 3 / 40, 0.5, -0.25 * (i % 4)], i % 2) for i in range(12)] + [(700, None, 1), (701, [NAN, 1.0, 1.0], 1), (702, [INF, 1.0, 1.0], 1), (703, [1.0, None, 1.0], 1), (704, [0.0, 0.0, 0.0], 1), (705, [1.0, 0.5, 0.0], None), (706, [1.0, 0.5], 1)]
DOCS = [(i, "\n".join([f"own {i}", " menu ", "", f"pair {i // 2}"]), "s%d" % (i % 3)) for i in range(40)] + [(50, None, "s0"), (51, "", "s0"), (52, "menu", None)]


@pytest.mark.parametrize("name", ORACLES)
def test_sql(spark, tmp_path, name):
    for table, rows, schema in (("pages", PAGES, "page_id long, url string, html string"), ("embeddings", VECTORS, "vec_id long, embedding array<float>, label int"), ("documents", DOCS, "doc_id long, text string, source string")):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{table}.parquet"))
    con = duckdb.connect()
    for table in ("pages", "embeddings", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    want = con.execute(ORACLES[name])
    columns = [x[0] for x in want.description]
    got = QUERIES[name](spark, str(tmp_path))
    assert sorted(got.columns) == sorted(columns)
    rows = want.fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, rows)) and rows
