import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from siftreel.llm import byte_bpe

VOCABULARY = P.path("byte_bpe_50k.tiktoken")
TEXTS = ["Hello  world, it's\n\n 12 things!", "", None, " ", "a b\x1c c ", "naïve café ☕️ 漢字 \U0001f600", "x" * 20_000, "word " * 3_000, "<|endoftext|>", "Hello  world, it's\n\n 12 things!", "퟿"]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i if i != 7 else None, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string, block int").repartition(3)


def test_round_trip(spark, docs, reference):
    tokens = byte_bpe.encode(docs, VOCABULARY, P.PATTERN)
    got = {r["doc_id"]: r for r in byte_bpe.decode(tokens, VOCABULARY).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        r = got[i if i != 7 else None]
        assert list(r["ids"]) == reference.encode_ordinary(t or "") and bytes(r["decoded"]).decode() == (t or "")


def test_digests(docs, reference):
    got = {r["doc_id"]: tuple(r)[1:] for r in byte_bpe.digests(docs, VOCABULARY, P.PATTERN).collect()}
    ids = reference.encode_ordinary(TEXTS[0])
    assert got[0] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(TEXTS[0].encode()).hexdigest())
    assert got[0] == got[9] and got[1] == got[2] == (0, hashlib.sha256().hexdigest(), hashlib.sha256().hexdigest())


def test_blocks_and_pages(spark, reference, monkeypatch):
    """Many blocks and pages give what one gives."""
    monkeypatch.setattr(byte_bpe, "BLOCK_TOKENS", 50)
    monkeypatch.setattr(byte_bpe, "PAGE_DOCS", 3)
    texts = [" ".join(f"w{i * j % 97}" for j in range(i % 40)) for i in range(300)]
    from siftreel.llm.byte_bpe import _assemble, _cut, _encode_words
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts), pa.array([0] * 300, pa.int64())], ["id", "text", "at"])
    content = type("Content", (), {"value": open(VOCABULARY, "rb").read()})
    words = pa.Table.from_batches(list(_encode_words(content)(_cut(P.PATTERN, 5, True)(iter([batch])))))
    both = pa.concat_tables([words, pa.Table.from_batches(list(_cut(P.PATTERN, 5, False)(iter([batch]))))]).sort_by([("block", "ascending"), ("kind", "ascending"), ("part", "ascending")])
    assert len(set(both["block"].to_pylist())) > 20
    out = pa.Table.from_batches(list(_assemble(iter(both.to_batches()))))
    assert dict(zip(out["doc_id"].to_pylist(), out["ids"].to_pylist(), strict=True)) == {i: reference.encode_ordinary(t) for i, t in enumerate(texts)}
    wrong = both.filter(pa.compute.or_(pa.compute.not_equal(both["kind"], 0), pa.compute.not_equal(both["part"], 0)))
    with pytest.raises(RuntimeError):
        list(_assemble(iter(wrong.to_batches())))


def test_empty_and_bad_ids(spark, docs):
    assert byte_bpe.encode(docs.limit(0), VOCABULARY, P.PATTERN).collect() == []
    odd = spark.createDataFrame([(1, None, "a"), (2, [], "b")], "doc_id long, ids array<int>, decoded string")
    assert {r["doc_id"]: r["decoded"] and bytes(r["decoded"]) for r in byte_bpe.decode(odd, VOCABULARY).collect()} == {1: None, 2: b""}
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_bpe.decode(spark.createDataFrame([(1, [50_256])], "doc_id long, ids array<int>"), VOCABULARY).collect()
