"""The stages in a row, against what plain Python says of each stage's input."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from siftreel.llm import quality, simhash  # noqa: E402


def documents(seed=11):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(3000)]
    line = lambda n: " ".join(r.choices(words, k=n))
    rows = []
    for i in range(160):
        body = [line(12) for _ in range(6)]
        if i % 4 == 0:
            text, y = " ".join(x.upper() + "!!" for x in " ".join(body).split()), 0
        else:
            text, y = "\n".join([*body, "follow us everywhere"] if i % 2 else body), 1
        rows.append((i, text, "en", "s%d" % (i % 2), len(text), y))
    for k in range(1, 20, 2):
        if k % 4:
            rows.append((500 + k, rows[k][1], *rows[k][2:]))  # exact copies
            rows.append((600 + k, rows[k][1].replace(rows[k][1].split()[30], "other", 1), *rows[k][2:]))  # near copies
    return rows


def test_stages(spark, tmp_path):
    rows = documents()
    spark.createDataFrame([x[:5] for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(x[0], x[5], 0) for x in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{k}"))
        if k < 3:
            assert out.columns == docs.columns
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen.append({r["doc_id"]: r.asDict() for r in docs.collect()})
    good = {x[0] for x in rows if x[5]}
    assert seen[0].keys() == good
    assert all("follow us" not in x["text"] and x["n_chars"] == len(x["text"]) for x in seen[1].values()) and seen[1].keys() == good
    assert seen[2].keys() == {i for i in good if i < 500}
    assert seen[3].keys() == seen[2].keys()
    total = {r["doc_id"]: r["doc_tokens"] for r in docs.collect()}
    assert docs.agg({"length": "sum"}).first()[0] == sum(total.values())
    got = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda df: sorted((r["doc_id"], r["start"], r["length"], bytes(r["ids"]), r["sequence_id"], r["offset"]) for r in df.collect())
    assert key(got) == key(docs)


def test_thresholds():
    assert quality.THRESHOLD == 0.3 and 0.8 <= simhash.most_bits(0.8, 1024) / 172 <= 1.2
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "packing"]
