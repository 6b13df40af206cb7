import numpy as np
import pytest

from siftreel.llm.embedding_dedup import bits_for, near_dups, tables_for
from siftreel.llm.topk import Candidates, Grid, top_k

ODD = [(1000, None, 1), (1001, [0.1, None, 0.2, 0.3], 1), (1002, [float("nan")] * 4, 1), (1003, [float("inf"), 0.0, 0.0, 0.0], 1), (1004, [0.5, 0.5], 1), (1005, [0.0] * 4, 1), (1006, [0.1, 0.2, 0.3, 0.4], None), (None, [0.1] * 4, 1), (1007, [], 1)]
SCHEMA = "vec_id long, embedding array<float>, label int, score string, v string"


def table(spark, n=80, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(0, 0.3, (n, 4)).astype(np.float32)
    x[10:20] = x[10]  # ties, and one vector many times
    x[20:24] = x[10] * 2
    return spark.createDataFrame([*[(i, [float(v) for v in e], i % 2 if i >= 24 else 1, "s", "v") for i, e in enumerate(x)], *[(*o, "s", "v") for o in ODD]], SCHEMA), x


@pytest.mark.parametrize("block, first", [(1 << 20, 2), (12, 1)])
def test_top_k(spark, block, first):
    df, x = table(spark)
    got = top_k(df, df.where("vec_id % 5 = 0"), k=6, block=block, first=first).collect()
    rows = {i: np.floor(1024 * e.astype(float)).astype(int) for i, e in enumerate(x)} | {1005: np.zeros(4, int), 1006: np.floor(1024 * np.array([0.1, 0.2, 0.3, 0.4], np.float32).astype(float)).astype(int)}
    want = set()
    for q in [i for i in rows if i % 5 == 0]:
        best = sorted(((-int(v @ rows[q]), i) for i, v in rows.items() if i != q))[:6]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_top_k_few(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [-2.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, top_k(df, df).collect())) == [(1, 1, 2, -2 * 1024 * 1024), (2, 1, 1, -2 * 1024 * 1024)]
    assert top_k(df.limit(0), df).collect() == [] == top_k(df, df.limit(0)).collect()


def test_large_numbers(spark):
    """Scores that doubles can't hold stay exact; those that 64 bits can't hold are refused."""
    df = spark.createDataFrame([(1, [3.0 * 2**29, 1.0]), (2, [3.0 * 2**29, 2.0]), (3, [3.0 * 2**29, 2.0]), (4, [-3.0 * 2**29, 5.0]), (9, [2.0**30, 1.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in top_k(df, df.where("vec_id = 9"), k=3, scale=1.0).collect()]
    assert sorted(got) == [(9, 1, 2, (3 << 59) + 2), (9, 2, 3, (3 << 59) + 2), (9, 3, 1, (3 << 59) + 1)]
    huge = spark.createDataFrame([(1, [4e9]), (2, [4e9])], "vec_id long, embedding array<double>")
    with pytest.raises(OverflowError):
        top_k(huge, huge)


def test_bounds_hold():
    """Every score lies within its bounds, and what is among the best is never left out, whatever the order."""
    r = np.random.default_rng(8)
    x = r.integers(-3_000, 3_000, (400, 6))
    x[::3, 2] = 7
    grid, q = Grid(x.min(0).tolist(), x.max(0).tolist()), x[:9]
    score, off = grid.bounds(grid.cells(x), q)
    assert (np.abs(score - q @ x.T) <= off[:, None]).all() and off.max() < 4e5
    kept = Candidates(9, 5)
    for s in r.permutation(8) * 50:
        rows = np.arange(s, s + 50)
        kept.add(rows, score[:, rows], off, np.arange(9)[:, None] == rows[None])
    for i in range(9):
        best = sorted((-(q[i] @ x[j]), j) for j in range(400) if j != i)[:5]
        assert {j for _, j in best} <= set(kept.row[kept.query == i].tolist())
    assert len(kept.row) < 9 * 60


def test_many_equal_vectors(spark):
    """Of equal vectors the smallest ids win, and no more of them are looked at than can."""
    df = spark.createDataFrame([(i, [1.0, 1.0] if i % 3 else [0.5, 2.0]) for i in range(300)], "vec_id long, embedding array<float>")
    got = [tuple(r)[:3] for r in top_k(df, df.where("vec_id in (1, 3)"), k=4).collect()]
    assert set(got) == {(1, k + 1, 3 * k) for k in range(4)} | {(3, 1, 0), (3, 2, 6), (3, 3, 9), (3, 4, 12)} and len(got) == 8


@pytest.mark.parametrize("chunk", [1_024, 5])
def test_near_dups(spark, chunk):
    """Whole buckets or pairs of chunks: links and components as by brute force."""
    r = np.random.default_rng(4)
    base = r.normal(0, 1, (30, 16))
    x = np.concatenate([base, base[:10] + r.normal(0, 0.12, (10, 16)), np.repeat(base[:1], 40, 0) + r.normal(0, 0.05, (40, 16)), np.repeat(base[1:2], 5, 0)]).astype(np.float32)
    label = [i % 3 for i in range(30)] + [i % 3 for i in range(10)] + [0] * 40 + [1] * 5
    df = spark.createDataFrame([*[(i, [float(v) for v in e], y, "s", "v") for i, (e, y) in enumerate(zip(x, label, strict=True))], *[(*o, "s", "v") for o in ODD]], SCHEMA)
    got = {r["vec_id"]: tuple(r)[1:] for r in near_dups(df, chunk=chunk).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = (u @ u.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None])
    np.fill_diagonal(link, False)
    least = list(range(len(x)))
    for _ in range(len(x)):
        least = [min([least[i], *(least[j] for j in np.flatnonzero(link[i]))]) for i in range(len(x))]
    want = {i: (int(link[i].sum()), least[i], least[i] == i) for i in range(len(x))} | {i: (0, i, True) for i in range(1000, 1008)}
    assert got == want and link.sum() > 1_000
    assert near_dups(df.limit(0)).collect() == []


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [2.0, -0.0], 0), (3, [0.0, 1.0], 0)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, near_dups(df).collect())) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]


def test_repeated_ids_and_vectors(spark):
    rows = [(1, [1.0])] * 3 + [(5, [1.0])] * 9 + [(6, [1.0]), (7, [1.0]), (8, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in top_k(df, df.where("vec_id in (5, 6)"), k=4, scale=2.0).collect()]
    assert sorted(got) == [(5, 1, 1, 4), (5, 2, 1, 4), (5, 3, 1, 4), (5, 4, 6, 4), (6, 1, 1, 4), (6, 2, 1, 4), (6, 3, 1, 4), (6, 4, 5, 4)]


def test_tables():
    """The more vectors, the more hyperplanes and tables, at the same share of missed pairs."""
    assert [bits_for(n) for n in (0, 5_000, 10**6, 10**9, 10**13)] == [4, 4, 12, 22, 24]
    for bits in (4, 12, 22):
        assert (1 - (1 - np.arccos(0.93) / np.pi) ** bits) ** tables_for(0.93, bits) <= 4e-4


@pytest.mark.parametrize("bits", [4, 10])
def test_recall(spark, bits):
    """Pairs right above the threshold are found in nearly all cases, farther ones always."""
    r = np.random.default_rng(5)
    base = r.normal(0, 1, (1_000, 32))
    near = base / np.linalg.norm(base, axis=1, keepdims=True)
    off = r.normal(0, 1, (1_000, 32))
    off -= (off * near).sum(1, keepdims=True) * near
    cos = r.uniform(0.931, 0.99, 1_000)[:, None]
    x = np.concatenate([near, cos * near + np.sqrt(1 - cos**2) * off / np.linalg.norm(off, axis=1, keepdims=True)])
    df = spark.createDataFrame([(i, [float(e) for e in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = near_dups(df, bits=bits).where("n_links > 0").count()
    assert got >= 1_994
