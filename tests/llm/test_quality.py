import random
from itertools import combinations
from zlib import crc32

import numpy as np
import pytest

from siftreel.llm import quality


def texts(n, seed):
    r = random.Random(seed)
    words = ["word%d" % i for i in range(400)]
    out = []
    for i in range(n):
        w = r.choices(words, k=r.randint(5, 120))
        kind = r.randrange(6)
        bad = {0: " ".join(x.upper() + "!!" for x in w), 1: " ".join(x + r.choice(["***", "$$$", "###"]) for x in w), 2: " ".join([w[0]] * len(w))}
        out.append((i, bad.get(kind, ". ".join(" ".join(w[k : k + 7]) for k in range(0, len(w), 7)) + "."), 0 if kind in bad else 1))
    return out


def test_sum_of_squares():
    r = np.random.default_rng(1)
    m = quality.Machine(50, 4)
    m.w0, m.w, m.v = 0.3, r.normal(size=50), r.normal(size=(50, 4))
    at, x = np.array([3, 7, 20, 49]), r.normal(size=4)
    z = m.w0 + m.w[at] @ x + sum(m.v[at[i]] @ m.v[at[j]] * x[i] * x[j] for i, j in combinations(range(4), 2))
    assert m.score(at, x) == pytest.approx(1 / (1 + np.exp(-z)))
    raw, _ = m.raw(np.concatenate([at, at[:2]]), np.concatenate([x, x[:2]]), np.array([0, 0, 0, 0, 1, 1]), 2)
    assert raw[0] == pytest.approx(z)


def test_held_out_accuracy(spark):
    data = texts(900, 3)
    docs = spark.createDataFrame([(i, t, "s", 0.5) for i, t, _ in data], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, y if i % 7 else None, 0) for i, _, y in data], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in quality.scored(docs, quality.train(docs, labels)).collect()}
    own = [(i, y) for i, _, y in data if crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= quality.THRESHOLD) == y for i, y in own]) > 0.97
    flags = {r["doc_id"]: r["h"] for r in docs.select("doc_id", quality.held_out(docs["doc_id"]).alias("h")).collect()}
    assert {i for i, h in flags.items() if h} == {i for i, _ in own}


def test_held_out_labels_have_no_part(spark):
    data = texts(200, 5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    both = []
    for flip in (0, 1):
        rows = [(i, y ^ (flip and crc32(str(i).encode()) % 5 == 0), 0) for i, _, y in data]
        both.append(quality.train(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int")))
    assert np.array_equal(both[0].w, both[1].w) and np.array_equal(both[0].v, both[1].v)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "text", None), (2, "", "b"), (3, "long " * 50_000, "c"), (4, "\n\n", "d"), (5, "***", "e")], "doc_id long, text string, c0 string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.scored(docs, quality.train(docs, labels))
    assert got.columns == ["doc_id", "text", "c0", "score"]
    rows = got.collect()
    assert len(rows) == 7 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if not r["text"]}) == 1
    assert quality.scored(docs.limit(0), quality.Machine(quality.BUCKETS + len(quality.STATISTICS))).collect() == []
