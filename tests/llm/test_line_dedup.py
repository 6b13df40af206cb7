import duckdb
import pytest

from siftreel.llm.line_dedup import line_dedup
from siftreel.llm.queries import ORACLES

SCHEMA = "doc_id long, text string, source string, h string, n_lines int, line string"


def rows(n=20):
    out = [(i, f"own line {i}\n common \n\nrare {i % 7}", "a", "x", 7, "y") for i in range(n)]
    return out + [(100 + i, "common\nelse", "b", None, None, None) for i in range(4)] + [(200, None, "a", "x", 1, "y"), (201, "", "a", "x", 1, "y"), (202, "common\n", None, "x", 1, "y"), (None, "common", "a", "x", 1, "y")]


def plain(data, ratio=0.3, least=5):
    pages, lines = {}, {}
    for _, text, host, *_ in data:
        if text is not None and host is not None:
            pages[host] = pages.get(host, 0) + 1
            for x in {x.strip(" ") for x in text.split("\n")} - {""}:
                lines[host, x] = lines.get((host, x), 0) + 1
    bad = {k for k, n in lines.items() if n >= least and n > ratio * pages[k[0]]}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(" ")) not in bad)) for i, t, h, *_ in data]


@pytest.mark.parametrize("limit", [200_000, 0])
def test_as_plain(spark, limit):
    """The small table is broadcast, a larger one joined with salted hosts; the result is the same."""
    data = rows() * 2
    got = line_dedup(spark.createDataFrame(data, SCHEMA), max_ratio=0.3, broadcast_lines=limit)
    assert got.columns == ["doc_id", "text", "source", "h", "line", "n_lines", "n_dropped"]
    found = got.collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in found) == sorted((str(a), str(b)) for a, b in plain(data))
    by = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in found}
    assert by[0] == (4, 1) and by[200] == (0, 0) and by[201] == (1, 0) and by[202] == (2, 0) and by[None] == (1, 1) and by[100] == (2, 2)
    assert {r["h"] for r in found} == {"x", None}


def test_empty_and_long(spark):
    assert line_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    long = "\n".join(f"line {i}" for i in range(50_000))
    got = line_dedup(spark.createDataFrame([(1, long, "a", "", 1, "")], SCHEMA)).first()
    assert got["text"] == long and got["n_lines"] == 50_000


def test_sql(spark, tmp_path):
    from siftreel.llm.queries import op1_line_dedup

    spark.createDataFrame([r for r in rows(60) if r[0] is not None], SCHEMA).select("doc_id", "text", "source").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLES["op1_line_dedup"]).fetchall()
    got = [tuple(r) for r in op1_line_dedup(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and sum(r[3] for r in got) >= 60
