import random
import re

import numpy as np
import pytest
import xxhash

from siftreel.llm import simhash

TEXTS = ["", None, " \t\n", "One", "one two", "ONE two three four", "one  two\nthree\x0bfour", "É é", "a b c d e f g " * 400, "x" * 50_000]


def brute(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints():
    r = random.Random(1)
    for text in [*TEXTS, *(" ".join(r.choices("abcdef", k=k)) for k in range(1, 80))]:
        assert int(simhash.fingerprint(text, 3)[0]) == brute(text)


def test_chain_is_necessary():
    """Every pair within the distance has a chain within the budgets; few other pairs do."""
    r = np.random.default_rng(2)
    diffs = r.integers(0, 2, (6, 4000)) * r.integers(0, 2, (6, 4000))
    assert simhash.chain_ok(diffs, 2)[diffs.sum(0) <= 2].all()
    assert not simhash.chain_ok(diffs, 2)[diffs.sum(0) > 2].any()


def planted(n=60, seed=3):
    """Fingerprints in clusters of near ones."""
    r = random.Random(seed)
    out = set()
    for _ in range(n):
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 6)):
            out.add(x)
            for b in r.sample(range(64), r.randint(0, 3)):
                x ^= 1 << b
    x = r.getrandbits(64)
    return sorted(out | {x ^ 1 << a ^ 1 << b for a in range(12) for b in range(12)})


@pytest.mark.parametrize("bucket", [1_024, 3])
def test_link_exact(spark, bucket):
    """Small buckets by pairs, large ones through the fingerprints halfway: the same components, as by brute force."""
    fps = planted()
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    got = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.link_exact(df, bucket=bucket).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in got)
    want = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 2]
    assert groups(got, fps) == groups(want, fps) and len(want) > 100
    with pytest.raises(ValueError):
        simhash.link_exact(df, most=3)


def test_near_dups(spark):
    r = random.Random(5)
    base = [" ".join(r.choices(["w%d" % i for i in range(300)], k=200)) for _ in range(8)]
    texts = TEXTS + base + [b.replace("w1 ", "W1 ").upper() for b in base] + [b + " end" for b in base]
    df = spark.createDataFrame([*[(i, t, "f", 0) for i, t in enumerate(texts)], (None, "x", "f", 0), (3, "One", "f", 0)], "doc_id long, text string, fp string, component_id int")
    got = simhash.near_dups(df).collect()
    assert len(got) == len(texts) + 1
    fp = [brute(t) for t in texts]
    want = groups([(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 2], range(len(fp)))
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(i, f"{x:016x}", want[i]) for i, x in enumerate(fp)}
    assert simhash.near_dups(df.limit(0)).collect() == []


def jaccard(a, b, n=5):
    a, b = (set(map(int, simhash.shingle_hashes(x, n))) for x in (a, b))
    return len(a & b) / max(1, len(a | b))


def test_keep_one(spark):
    r = random.Random(7)
    vocabulary = ["w%d" % i for i in range(5000)]
    base = [r.choices(vocabulary, k=300) for _ in range(60)]
    rows, kept = [(i, " ".join(b)) for i, b in enumerate(base)], set(range(60))
    for i, b in enumerate(base[:40]):
        for k in range(3):
            x = list(b)
            for at in r.sample(range(300), 2 + k):
                x[at] = "new%d" % r.randrange(10**6)
            rows.append((100 + 10 * i + k, " ".join(x)))
            assert jaccard(" ".join(b), rows[-1][1]) >= 0.8
    for i, b in enumerate(base[40:]):  # half of the words are others: stays
        rows.append((1000 + i, " ".join(b[:150] + r.choices(vocabulary, k=150))))
        kept.add(1000 + i)
    rows += [(2000, " ".join(base[0])), (3000, None), (3001, ""), (None, "one"), (None, "one")]
    kept |= {3000, None}
    df = spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id long, text string, gone string")
    got = [r["doc_id"] for r in simhash.keep_one(df).collect()]
    assert set(got) == kept and len(got) == len(kept) + 1
    assert simhash.keep_one(df).columns == ["doc_id", "text", "gone"] and simhash.keep_one(df.limit(0)).collect() == []


def test_large_buckets(spark, monkeypatch):
    """Many near copies share buckets: leaders and their groups connect them as pairs would."""
    r = np.random.default_rng(9)
    base = r.integers(0, 2**64, 16, np.uint64)
    fps = []
    for _ in range(120):
        x = base.copy()
        for b in r.choice(1024, 60, replace=False):
            x[b // 64] ^= np.uint64(1 << int(b % 64))
        fps.append(x)
    fps += [r.integers(0, 2**64, 16, np.uint64) for _ in range(60)]
    df = spark.createDataFrame([(i, bytearray(x.astype(">u8").tobytes())) for i, x in enumerate(fps)], "id long, fp binary")
    got = [tuple(x) for x in simhash.link_similar(df, 172).collect()]
    assert groups(got, range(180)) == {i: 0 if i < 120 else i for i in range(180)}


def test_links_pass_the_full_check(spark):
    """A leader that is alike in the chain only doesn't part two members that are near copies."""
    r = np.random.default_rng(11)
    base = r.integers(0, 2**64, 16, np.uint64)
    fps = []
    for _ in range(30):  # one long passage in common, the rest its own; two near copies each, which differ right after it
        x = np.concatenate([base[:3], r.integers(0, 2**64, 13, np.uint64)]).astype(">u8").view(">u2").copy()
        y = x.copy()
        for k in range(12, 64):
            for bit in r.choice(16, 8 if k < 15 else 2, replace=False).tolist():
                y[k] ^= 1 << bit
        fps += [x, y]
    df = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(fps)], "id long, fp binary")
    got = [tuple(x) for x in simhash.link_similar(df, 172).collect()]
    assert groups(got, range(60)) == {i: i - i % 2 for i in range(60)}


def test_buckets_beyond_what_is_held(spark, monkeypatch):
    """Near copies that share one segment only: the parts of its bucket meet each other."""
    for name, size in (("HELD", 8), ("PART", 5), ("ALL_PAIRS", 2), ("GAPS", 4), ("SQUARE", 6)):
        monkeypatch.setattr(simhash, name, size, raising=False)
    base, fps = np.random.default_rng(12).integers(0, 2**16, 64).astype(">u2"), []
    for k in range(16):
        fps.append(base ^ np.uint16(1 << k))
        fps[-1][11] = base[11]
    df = spark.createDataFrame([(i, bytearray(x.astype(">u2").tobytes())) for i, x in enumerate(fps)], "id long, fp binary")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        got = [tuple(x) for x in simhash.link_similar(df, 172).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert groups(got, range(16)) == dict.fromkeys(range(16), 0)


def test_exact_similarity(spark):
    """Texts just below 0.8 stay, texts at 0.8 or just above are found."""
    r, rows, stay = random.Random(13), [], set()
    for i in range(150):
        base = ["w%d" % r.randrange(10**6) for _ in range(304)]
        x = list(base)
        for at in range(5, 5 + 10 * (7 if i % 2 else 6), 10):  # five shingles each: 265 / 335 and 270 / 330
            x[at] = "new%d" % r.randrange(10**6)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(x))]
        alike = jaccard(rows[-2][1], rows[-1][1])
        assert 0.75 < alike < 0.85 and (alike >= 0.8) == (i % 2 == 0)
        stay |= {2 * i, 2 * i + 1} if alike < 0.8 else {2 * i}
    got = {x["doc_id"] for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == stay
