import json
from zlib import crc32

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from siftreel.llm import packing

VOCABULARY = P.path("word_bpe_49k.json")
TEXTS = ["Hello World, it's 12 o'clock!", "", None, "a  b\n\nc\td", "naïve İstanbul ΑΣ ﬁn é 漢字", "x <|endoftext|> y", "word. " * 5_000, "q" * 9_000, "THE!! *** 3.14 | a_b", "   z"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def test_encoder(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "MEMO", 5)  # words are forgotten and learnt again
    e = packing.Encoder(open(VOCABULARY, "rb").read())
    for _ in range(3):
        for s in range(0, len(TEXTS), 2):
            got = e.batch(TEXTS[s : s + 2], 1)
            assert [x.tolist() for x in got] == [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in TEXTS[s : s + 2]]


def test_bm25():
    docs = [np.array(x, np.uint16) for x in ([1, 2, 2, 3], [2, 4], [5, 5, 5, 5, 5])]
    index, got = packing.Index(docs), None
    got = index.scores(np.array([2, 5]))
    mean, want = 11 / 3, []
    for d in docs:
        s = 0
        for t in (2, 5):
            df, tf = sum(t in x for x in docs), int((d == t).sum())
            s += np.log1p((3 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        want.append(s)
    assert np.allclose(got, want)


def test_pack_full_and_alike():
    r = np.random.default_rng(1)
    docs = [r.integers(100 * (i % 4), 100 * (i % 4) + 100, r.integers(1, 700)).astype(np.uint16) for i in range(200)]
    windows, left = packing.pack(docs)
    assert not left
    seen = np.zeros(200, int)
    for w in windows:
        for d, start, n in w:
            assert n > 0
            seen[d] += n
    assert seen.tolist() == [len(d) for d in docs] and all(sum(n for *_, n in w) == 2048 for w in windows[:-1])
    pure = sum(len({d % 4 for d, *_ in w}) == 1 for w in windows)
    assert pure > 0.8 * len(windows)  # neighbours come from the seed's topic


def check(rows, docs, tokenizer, window=2048):
    want = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in docs}
    place, at = {}, {}
    for r in rows:
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["length"] > 0
        if "ids" in r:
            assert np.array_equal(np.frombuffer(r["ids"], "<u2"), ids[r["start"] : r["start"] + r["length"]])
        else:
            assert r["ids_crc32"] == crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        place.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        at.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for pieces, end in [*((x, None) for x in place.values()), *((at[i], len(x)) for i, x in want.items())]:
        pos = 0
        for start, n in sorted(pieces):
            assert start == pos
            pos += n
        assert pos <= window if end is None else pos == end


@pytest.mark.parametrize("shard", [1_024, 3])
def test_rows(spark, tokenizer, shard):
    docs = [*enumerate(TEXTS), *((100 + i, "some words here " * (i * 7 % 50)) for i in range(60))]
    df = spark.createDataFrame([(i, t, "i", 1) for i, t in docs], "doc_id long, text string, ids string, shard int")
    got = packing.packed(df, VOCABULARY, shard_docs=shard)
    assert got.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    check([r.asDict() for r in got.collect()], docs, tokenizer)
    check([r.asDict() for r in packing.digests(df, VOCABULARY).collect()], docs, tokenizer)
    assert packing.packed(df.limit(0), VOCABULARY).collect() == []


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a"), (None, None), (1, "b b"), (1, "b b")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["length"]) for r in packing.packed(df, VOCABULARY).collect())
    assert got == [("1", 3), ("1", 3), ("None", 1), ("None", 2)]
    assert json.loads(open(VOCABULARY).read())["model"]["vocab"]['"'] == 1


def words_of_topics(r, n):
    words = [[f"{a}{b}{c}" for a in "bdfg"[t] for b in "aeiou" for c in "klmnprst"] for t in range(4)]
    return [(i, " ".join(r.choice(words[i % 4], r.integers(50, 300)))) for i in range(n)]


def test_topics_meet_in_shards(spark, tokenizer):
    """Windows are filled by topic, however the documents lie in the input."""
    docs = words_of_topics(np.random.default_rng(3), 160)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    got = [x.asDict() for x in packing.packed(df, VOCABULARY, shard_docs=40).collect()]
    check(got, docs, tokenizer)
    topics, sizes = {}, {}
    for x in got:
        topics.setdefault(x["sequence_id"], set()).add(x["doc_id"] % 4)
        sizes[x["sequence_id"]] = sizes.get(x["sequence_id"], 0) + x["length"]
    assert sum(n < 2048 for n in sizes.values()) <= 4  # one for each task
    assert sum(len(t) == 1 for t in topics.values()) >= 0.5 * len(topics)


def plain_scores(docs, seed):
    n, mean, out = len(docs), np.mean([len(d) for d in docs]), []
    df = {t: sum(t in d for d in docs) for t in set(docs[seed])}
    for d in docs:
        tf = {t: d.count(t) for t in df}
        out.append(sum(np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in df))
    return out


@pytest.mark.parametrize("keep", [0, 9])
def test_neighbours_by_brute_force(keep):
    """Each window: the longest open rest, then open neighbours by falling score, then the longest ones."""
    r = np.random.default_rng(5)
    docs = [(r.integers(0, 40, r.integers(1, 90)) + 100 * (i % 3)).astype(np.uint16) for i in range(60)]
    docs += [docs[7], docs[7]]  # ties
    plain, left = [d.tolist() for d in docs], [len(d) for d in docs]
    windows, over = packing.pack(docs, 200, keep=keep)
    for w in windows:
        seed = w[0][0]
        assert left[seed] == max(left) or len(docs[seed]) == max(len(d) for d, x in zip(docs, left, strict=True) if x)
        score = plain_scores(plain, seed)
        near = sorted((i for i, x in enumerate(left) if x and i != seed and score[i] > 0), key=lambda i: (-round(score[i], 9), i))
        far = sorted((i for i, x in enumerate(left) if x and i != seed and score[i] <= 0), key=lambda i: (-len(docs[i]), i))
        assert [i for i, *_ in w[1:]] == (near + far)[: len(w) - 1]
        for i, start, n in w:
            assert start == len(docs[i]) - left[i]
            left[i] -= n
    assert {i: s for i, s in over} == {i: len(docs[i]) - x for i, x in enumerate(left) if x}
    assert bool(over) == bool(keep)


def test_near_copies_share_a_key():
    r = np.random.default_rng(6)
    docs = [r.integers(0, 5_000, 300).astype(np.uint16) for _ in range(300)]
    near = [np.where(r.random(300) < 0.03, r.integers(0, 5_000, 300), d).astype(np.uint16) for d in docs]
    idf = packing.idf_of(np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=1 << 16), 300)
    a, b = (packing.keys_of(*packing._distinct(x), idf.astype(np.float32), 300) >> 32 for x in (docs, near))
    assert (a == b).mean() > 0.85 and len(set(a.tolist())) > 30


def test_other_vocabulary(tmp_path, tokenizer):
    """A tokenizer with other rules is used as it is; one with ids beyond 16 bits is refused."""
    spec = json.loads(open(VOCABULARY).read())
    spec["normalizer"] = None
    e = packing.Encoder(json.dumps(spec).encode())
    other = Tokenizer.from_str(json.dumps(spec))
    for t in TEXTS:
        assert e.batch([t], 1)[0].tolist() == [*other.encode(t or "", add_special_tokens=False).ids, 1]
    spec["model"]["vocab"]["zzzzzz"] = 70_000
    with pytest.raises(ValueError, match="65,536"):
        packing.Encoder(json.dumps(spec).encode())
