"""Byte-level BPE encoding and decoding through a global distinct-word shuffle.

1. Texts are cut into pre-tokens. Each block of documents keeps its distinct words once, and every position as a number
   of a word: this is the exploded (document, position, word) relation, by columns and compressed.
2. The words of all blocks are shuffled by their hash; each distinct word of the table is in one shard and is encoded once.
   A shard's task holds its distinct words, so shards (the session's shuffle partitions) should grow with the input.
3. The ids go back to their blocks, meet the positions there, and are put together by position.

Words and positions come from two passes over the texts, since keeping the positions for later takes more disk than
cutting again takes time. Both carry a checksum of the block's words; a block whose rows came in another order fails.

Decoding joins ids with the table of token bytes, which is as large as the vocabulary and no larger.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import batched
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, ship, trim

#: Pre-tokens of a block, documents and pre-tokens of a page (what is put together at a time).
BLOCK_TOKENS, PAGE_DOCS, PAGE_TOKENS = 2_000_000, 256, 300_000

Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def ranks_of(content: bytes) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: a line each, base64 and number."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


@lru_cache(4)
def _splitter(pattern: str) -> Callable[[str], list[str]]:
    """White space is Unicode's property, as in the tokenizer library, not Python's idea of it."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall


@lru_cache(2)
def _encoder(content: bytes) -> Callable[[str], list[int]]:
    """Ids of one word: the pattern takes whatever there is as a single match."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks_of(content), special_tokens={}).encode_ordinary


@lru_cache(2)
def _token_bytes(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table: bytes of all ids in a row, and where each begins."""
    by_id = {i: t for t, i in ranks_of(content).items()}
    pieces = [by_id.get(i, b"") for i in range(max(by_id, default=-1) + 1)]
    return np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)


def _gather(flat: np.ndarray, starts: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The concatenation of flat[starts[i]:starts[i+1]] for i in items, and the lengths."""
    size = starts[items + 1] - starts[items]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[items] - ends + size, size) + np.arange(total)], size


def _planes(x: np.ndarray) -> bytes:
    """uint32 numbers, compressed byte by byte."""
    return zstandard.ZstdCompressor(3).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


_PART = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("ids", pa.list_(pa.int64())), ("data", pa.binary())])
_PART_SQL = "block long, kind int, part int, ids array<long>, data binary"
WORDS, SHARDS, PAGE = 0, 1, 2


def _numbers_of(words: list[str], seen: dict[str, int]) -> np.ndarray:
    """The words' numbers in order of first appearance; new words are added."""
    new = [w for w in dict.fromkeys(words) if w not in seen]
    seen.update(zip(new, range(len(seen), len(seen) + len(new)), strict=True))
    return np.fromiter(map(seen.__getitem__, words), np.uint32, len(words))


def _cut(pattern: str, shards: int, words: bool) -> Kernel:
    """words: send out the blocks' distinct words; else their positions."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        findall, block = _splitter(pattern), None
        seen, ids, seqs, n = {}, [], [], 0

        def rows() -> Iterator[tuple]:
            number = np.concatenate(seqs)
            raw = [w.encode() for w in seen]
            total = reduce(lambda c, w: crc32(w, c), raw, 0)
            by = np.argsort(-np.bincount(number, minlength=len(raw)), kind="stable")  # frequent words get small numbers
            of = np.fromiter((crc32(raw[i]) % shards for i in by.tolist()), np.int64, len(by))
            if words:
                order = np.argsort(of, kind="stable")
                cuts = np.searchsorted(of[order], np.arange(shards + 1))
                for s in range(shards):
                    if cuts[s] < cuts[s + 1]:
                        mine = [raw[i] for i in by[order[cuts[s] : cuts[s + 1]]].tolist()]
                        sizes = np.array([len(w) for w in mine], "<u4").tobytes()
                        yield block, WORDS, s, None, np.array([len(mine), total], "<u4").tobytes() + zstandard.ZstdCompressor(3).compress(sizes + b"".join(mine))
                return
            yield block, SHARDS, 0, None, _planes(np.concatenate([[total], of]))
            new = np.empty(len(raw), np.uint32)
            new[by] = np.arange(len(raw))
            lengths, k, page = [len(s) for s in seqs], 0, 0
            while k < len(ids):
                e, m = k, 0
                while e < len(ids) and (e == k or (e - k < PAGE_DOCS and m + lengths[e] <= PAGE_TOKENS)):
                    m += lengths[e]
                    e += 1
                yield block, PAGE, page, ids[k:e], _planes(np.concatenate([[e - k], lengths[k:e], *[new[x] for x in seqs[k:e]]]))
                k, page = e, page + 1

        def flush() -> Iterator[pa.RecordBatch]:
            for some in batched(rows(), 32):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), _PART, strict=True)], schema=_PART)

        for batch in it:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                if block is None:  # the input's partition, in either pass
                    block = part["at"][0].as_py() << 24
                for i, text in zip(part["id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    seqs.append(_numbers_of(findall(text) if text else [], seen))
                    ids.append(i)
                    n += len(seqs[-1])
                    if n >= BLOCK_TOKENS:
                        yield from flush()
                        seen, ids, seqs, n, block = {}, [], [], 0, block + 1
        if ids:
            yield from flush()
        seen, ids, seqs = {}, [], []
        trim()

    return run


def _encode_words(content) -> Kernel:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known = _encoder(content.value), {}
        number = np.dtype(np.uint16 if max(ranks_of(content.value).values(), default=0) < 1 << 16 else np.uint32)
        for b in it:
            for k in range(b.num_rows):
                part, data = b.slice(k, 1), b["data"][k].as_py()
                n, total = np.frombuffer(data[:8], "<u4").tolist()
                raw = zstandard.ZstdDecompressor().decompress(data[8:])
                ends = np.cumsum(np.frombuffer(raw[: 4 * n], "<u4").astype(np.int64)) + 4 * n
                ids, at = [], 4 * n
                for e in ends.tolist():
                    w = raw[at:e]
                    at = e
                    if (x := known.get(w)) is None:
                        x = known[w] = np.array(encode(w.decode()), number).tobytes()
                    ids.append(x)
                out = _planes(np.concatenate([[total, n], [len(x) // number.itemsize for x in ids], np.frombuffer(b"".join(ids), number)]))
                yield pa.RecordBatch.from_arrays([part["block"], part["kind"], part["part"], pa.nulls(1, pa.list_(pa.int64())), pa.array([out], pa.binary())], schema=_PART)
        known.clear()
        trim()

    return run


def _assemble(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, blobs, flat, starts = None, [], None, None
    for b in it:
        for k, (at, kind) in enumerate(zip(b["block"].to_pylist(), b["kind"].to_pylist(), strict=True)):
            x = _numbers(b["data"][k].as_buffer())
            if at != block:
                if blobs:
                    raise RuntimeError("the two passes over the texts met different blocks; write the input to a table first")
                block, blobs, flat, starts = at, [], None, None
            if kind == WORDS:
                blobs.append(x)
            elif kind == SHARDS:  # which shard each word of the block went to: the shards' lists lie one after another
                order = np.argsort(x[1:], kind="stable")
                size = np.concatenate([y[2 : 2 + y[1]] for y in blobs] or [np.zeros(0, np.uint32)]).astype(np.int64)
                if len(size) != len(order) or any(y[0] != x[0] for y in blobs):
                    raise RuntimeError("the two passes over the texts met different blocks; write the input to a table first")
                values = np.concatenate([y[2 + y[1] :] for y in blobs] or [np.zeros(0, np.uint32)])
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                flat, size = _gather(values, np.concatenate([[0], np.cumsum(size)]), place)
                starts, blobs = np.concatenate([[0], np.cumsum(size)]), []
            else:
                counts, seq = x[1 : 1 + x[0]].astype(np.int64), x[1 + x[0] :]
                got, size = _gather(flat, starts, seq)
                ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
                tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(got.view(np.int32)))
                yield pa.RecordBatch.from_arrays([b["ids"][k].values, tokens], ["doc_id", "ids"])
    trim()


def decode_kernel(content) -> Kernel:
    """Adds decoded (binary) to batches with ids (lists of int)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, starts = _token_bytes(content.value)
        for b in it:
            ids = b["ids"]
            size = np.diff(ids.offsets.to_numpy()) if b.num_rows else np.zeros(0, np.int64)
            tokens = ids.values.to_numpy(zero_copy_only=False)[ids.offsets[0].as_py() if b.num_rows else 0 :][: size.sum()]
            if len(tokens) and not (np.nanmin(tokens) >= 0 and np.nanmax(tokens) < len(starts) - 1):
                raise ValueError("a token id is not in the vocabulary")
            data, each = _gather(flat, starts, tokens.astype(np.int64))
            ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(size)])].astype(np.int64)
            out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.binary())
            if ids.null_count:
                out = pa.compute.if_else(ids.is_null(), pa.scalar(None, pa.binary()), out)
            yield pa.RecordBatch.from_arrays([*b.columns, out], [*b.schema.names, "decoded"])

    return run


def _then(*kernels: Kernel) -> Kernel:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k in kernels:
            it = k(it)
        return it

    return run


def encode(docs: DataFrame, vocabulary: str, pattern: str, id: str = "doc_id", text: str = "text", then: tuple[Kernel, ...] = (), schema: str = "doc_id long, ids array<int>") -> DataFrame:
    """(doc_id, ids) of every row: the byte-level BPE ids of its whole text, each match of the pattern by itself.

    vocabulary: path of a rank file (read by the driver; its content, no larger than a vocabulary, is sent out). Null
    and empty texts get an empty list, null ids stay null, repeated rows come out repeatedly, no rows give none. then:
    further kernels over the result's batches, and schema: what the last one returns.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(vocabulary, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())
    n = partitions(spark)
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"), F.spark_partition_id().cast("long").alias("at"))
    words, positions = (rows.mapInArrow(_cut(pattern, n, x), _PART_SQL) for x in (True, False))
    both = words.repartition(n, "part").mapInArrow(_encode_words(content), _PART_SQL).unionByName(positions)
    at, nth = F.shiftright("block", 24), F.col("block") % (1 << 24)
    return both.repartitionById(n, F.pmod(at * 7 + nth, F.lit(n)).cast("int")).sortWithinPartitions("block", "kind", "part").mapInArrow(_then(_assemble, *then), schema)


def decode(tokens: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """tokens with decoded (binary): the bytes of the ids in a row. Null lists give null; ids that aren't in the vocabulary fail."""
    spark = tokens.sparkSession
    ship(spark)
    with open(vocabulary, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())
    kernel, others = decode_kernel(content), [c for c in tokens.columns if c not in (ids, "decoded")]
    from pyspark.sql import types as T

    schema = T.StructType([*[tokens.schema[c] for c in others], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    out = tokens.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{ids}`").cast("array<int>").alias("ids")).mapInArrow(kernel, schema)
    return out.withColumnRenamed("ids", ids) if ids != "ids" else out


def digest_kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_tokens, and SHA-256 of the ids (little-endian unsigned 32-bit) and of the decoded bytes."""
    for b in it:
        at = b["ids"].offsets.to_numpy()
        values = b["ids"].values.to_numpy().astype("<u4")
        one = [hashlib.sha256(values[s:e]).hexdigest() for s, e in zip(at, at[1:], strict=False)]
        two = [hashlib.sha256(memoryview(x.as_buffer())).hexdigest() for x in b["decoded"]]
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(np.diff(at), pa.int64()), pa.array(one), pa.array(two)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """encode, then decode, then digest_kernel, batch by batch in one pass."""
    with open(vocabulary, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    return encode(docs, vocabulary, pattern, then=(decode_kernel(content), digest_kernel), schema="doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
