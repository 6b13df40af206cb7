"""Lexical retrieval packing: fill windows of tokens with documents that a BM25 index finds alike.

A document longer than a window first fills windows by itself; its rest, shorter than a window, is a document of the
index. The longest unused rest of a shard seeds a window: BM25 ranks the shard's unused rests against it, and the best
ones fill the window greedily; the last one is cut and what is left of it stays unused. Rests that share no term with
the seed are taken, longest first, only when no neighbour is unused.

Shards hold documents that are lexically alike. Each rest draws some of its terms, in proportion to their weight in it
and with the same random numbers everywhere (weighted minwise hashing), so two rests draw the same term with the
probability of their weighted Jaccard similarity. The draws in a row are the sort key; neighbours in that order make a
shard. Ranges of the key are dealt to tasks by quantiles of a sample, which also gives the weights for the draws. The
statistics of BM25 (document frequencies, mean length) are those of the whole table. What a shard leaves unused goes on
into the next one. Time, shuffle and memory of a task are linear in the input; the driver holds nothing by document.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, ship, table, trim

#: Tokens of a window; rests of a shard; BM25's parameters; words that a task remembers.
WINDOW, SHARD_DOCS, K1, B, MEMO = 2_048, 2_048, 1.2, 0.75, 500_000
#: Documents of the sample at least, and for each task; draws of a key; most tasks that send document frequencies.
SAMPLE, SAMPLE_EACH, DRAWS, SENDERS = 2_048, 32, 3, 64
#: Share of a shard's rests that may go on into the next shard.
CARRIED = 8
TERMS = 1 << 16


PIECES_SQL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


# ---- tokens

#: The rules that Encoder follows itself; a tokenizer with others is used as it is.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRE = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


@lru_cache(2)
def _tokenizer(content: bytes):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_buffer(content)
    t.encode_special_tokens = False
    spec = json.loads(content)
    if max(t.get_vocab().values(), default=0) >= TERMS:
        raise ValueError("vocabularies of over 65,536 ids are not supported")
    own = spec["normalizer"] == _NORMALIZER and spec["pre_tokenizer"] == _PRE and spec["model"]["end_of_word_suffix"] == "</w>"
    return t, tuple(x["content"] for x in spec["added_tokens"]), own


#: Words of these characters are lower-cased, cut and spelt in bytes here, as the tokenizer would; others it takes itself.
_PLAIN = regex.compile(r"[!-~À-ÖØ-öø-įıĳ-ňŊ-ɏ]+").fullmatch
_PIECES = regex.compile(_SPLIT).findall


#: Of each Latin-1 character: a dot if it is neither letter, digit nor space.
_KINDS = bytes(0x61 if c.isalnum() else 0x20 if c.isspace() and not "\x1c" <= c <= "\x1f" else 0x2E for c in map(chr, range(256)))


def _plainer(text: str) -> str:
    """A text of the same ids with fewer distinct words: in lower case, with marks apart, if Latin-1 without adjacent marks."""
    try:
        kinds = text.encode("latin-1").translate(_KINDS)
    except UnicodeEncodeError:
        return text.replace("\n", " ")
    text = text.lower().replace("\n", " ")
    if b".." not in kinds:
        for mark in ",.;:!?":
            text = text.replace(mark, f" {mark} ")
    return text


@lru_cache(1)
def _byte_chars() -> dict[int, str]:
    """The characters that byte-level models spell bytes with: printable ones stand for themselves, the rest follow 255."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in set(own))}


class _Known(dict):
    """Numbers of words. Words that were known before keep theirs; unknown ones get the next number and wait in new."""

    def __init__(self):
        self.new: list[str] = []
        self.before: dict[str, int] = {}
        self.next = 0

    def __missing__(self, word: str) -> int:
        k = self.before.get(word)
        if k is None:
            self.new.append(word)
            k = self.next
            self.next += 1
        self[word] = k
        return k


def _gather(flat: np.ndarray, starts: np.ndarray, items: np.ndarray, more: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The concatenation of flat[starts[i]:starts[i+1]] for i in items, with room for more, and the lengths."""
    first = starts[items]
    size = starts[items + 1] - first
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    out = np.empty(total + more, flat.dtype)
    out[:total] = flat[np.repeat(first - ends + size, size) + np.arange(total)]
    return out, size


class Encoder:
    """Ids by a tokenizer whose pieces never reach over white space: each distinct word is encoded once and remembered."""

    def __init__(self, content: bytes):
        self.tokenizer, self.special, self.own = _tokenizer(content)
        self.model = self.tokenizer.model
        self.clear()

    def clear(self) -> None:
        self.known, self.before, self.pieces = _Known(), {}, {}
        self.flat, self.starts, self.used = np.zeros(1 << 16, np.uint16), np.zeros(1 << 14, np.int64), 0

    def _age(self) -> None:
        """Forget the words that didn't occur since the last time; the others move close together."""
        words, k = list(self.known), np.fromiter(self.known.values(), np.int64, len(self.known))
        flat, size = _gather(self.flat, self.starts, k)
        self.known, self.before = _Known(), dict(zip(words, range(len(words)), strict=True))
        self.flat, self.starts, self.used = flat, np.concatenate([[0], np.cumsum(size)]), len(flat)
        self.known.before, self.known.next = self.before, len(words)
        if len(self.pieces) > MEMO:
            self.pieces = {}

    def _piece(self, piece: str) -> tuple[int, ...]:
        ids = self.pieces.get(piece)
        if ids is None:
            spelt = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_byte_chars())
            ids = self.pieces[piece] = tuple([t.id for t in self.model.tokenize(spelt)])
        return ids

    def _ids(self, word: str) -> tuple[int, ...]:
        """A word of another kind than a plain one with perhaps a mark."""
        if not _PLAIN(word):
            return tuple(self.tokenizer.encode(word, add_special_tokens=False).ids)
        return tuple(chain.from_iterable(map(self._piece, _PIECES(word.lower()))))

    def _learn(self) -> None:
        ids: list[tuple[int, ...]] = []
        add, tokenize = ids.append, self.model.tokenize
        for word in self.known.new:
            if word.isalpha() and (word.isascii() or (max(word) < "ɐ" and "İ" not in word)):
                spelt = word.lower()
                add(tuple([t.id for t in tokenize(spelt if spelt.isascii() else spelt.encode().decode("latin-1").translate(_byte_chars()))]))
            else:
                add(self._ids(word))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        end, total = self.known.next, int(sizes.sum())
        while len(self.starts) < end + 1:
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while len(self.flat) < self.used + total:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint16, total)
        self.starts[end - len(ids) + 1 : end + 1] = self.used + np.cumsum(sizes)
        self.used += total
        self.known.new = []

    def batch(self, texts: list[str | None], end: int) -> list[np.ndarray]:
        """The ids of each text, and the end id after them."""
        if len(self.known) > MEMO:
            self._age()
        get, numbers, out = self.known.__getitem__, [], []
        for t in texts:
            if t and (not self.own or any(s in t for s in self.special)):  # a special token may take white space around it
                numbers.append(None)
            else:
                w = _plainer(t or "").split(" ")
                numbers.append(np.fromiter(map(get, w), np.int64, len(w)))
        if self.known.new:
            self._learn()
        for k, t in zip(numbers, texts, strict=True):
            if k is None:
                out.append(np.array([*self.tokenizer.encode(t, add_special_tokens=False).ids, end], np.uint16))
                continue
            x, _ = _gather(self.flat, self.starts, k, 1)
            x[-1] = end
            out.append(x)
        return out


def tokens(docs: DataFrame, vocabulary: str, end: int = 1, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids): binary, little-endian unsigned 16-bit ids of every row, the end id last. Null texts: as empty ones."""
    spark = docs.sparkSession
    ship(spark)
    with open(vocabulary, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(content.value)
        for b in it:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                ids = encoder.batch(part["text"].to_pylist(), end)
                yield pa.RecordBatch.from_arrays([part["id"], pa.array([x.astype("<u2").tobytes() for x in ids], pa.binary())], ["id", "ids"])
        encoder.clear()
        trim()

    rows = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "id long, ids binary")


# ---- the index

def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5))


class Index:
    """An inverted BM25 index over token ids. whole: (idf of each term, mean length) of a table that docs are a part of."""

    def __init__(self, docs: list[np.ndarray], terms: int = 1 << 16, whole: tuple[np.ndarray, float] | None = None):
        n = len(docs)
        length = np.array([len(d) for d in docs], np.float64)
        wide = np.uint32 if terms * n < 2**32 else np.uint64
        key = np.concatenate([d.astype(wide) * wide(n) + wide(i) for i, d in enumerate(docs)])  # (term, document)
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        tf = np.diff(np.concatenate([first, [len(key)]]))
        key = key[first]
        term, self.doc = key // wide(n), (key % wide(n)).astype(np.intp)
        df = np.bincount(term, minlength=terms)
        idf, mean = whole or (idf_of(df, n), length.mean())
        norm = K1 * (1 - B + B * length / mean)
        weight = idf[term] * tf * (K1 + 1) / (tf + norm[self.doc])
        often = np.flatnonzero(df * 8 >= n)  # their postings are kept as whole rows
        self.row = np.full(terms, -1)
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), n), np.float32)
        dense = self.row[term] >= 0
        self.rows[self.row[term[dense]], self.doc[dense]] = weight[dense]
        self.doc, self.weight = self.doc[~dense], weight[~dense]
        df[often] = 0
        self.starts, self.n = np.concatenate([[0], np.cumsum(df)]), n

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """BM25 of every document for distinct query terms."""
        row = self.row[terms]
        asked = np.zeros(len(self.rows), np.float32)
        asked[row[row >= 0]] = 1
        out = (asked @ self.rows).astype(np.float64)
        terms = terms[row < 0]
        a = self.starts[terms]
        size = self.starts[terms + 1] - a
        ends = np.cumsum(size)
        if len(ends):
            at = np.repeat(a - ends + size, size) + np.arange(ends[-1])
            out += np.bincount(self.doc[at], self.weight[at], self.n)
        return out


def pack(rests: list[np.ndarray], window: int = WINDOW, whole: tuple[np.ndarray, float] | None = None, keep: int = 0) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int]]]:
    """Windows of (rest, start, length) pieces, and (rest, start) of what isn't packed.

    Each token lies in one piece. All windows are full but the last. whole: statistics for the index, else those of the
    rests. keep: stop when only so many rests are open or they can't fill a window; with 0 everything is packed.
    """
    out: list[list[tuple[int, int, int]]] = []
    if not rests:
        return out, []
    index = Index(rests, whole=whole)
    n = len(rests)
    at, left = [0] * n, [len(d) for d in rests]
    by_size = sorted(range(n), key=lambda i: -left[i])
    open_, nxt, total, opened = np.ones(n, bool), 0, sum(left), n
    while total and not (keep and (opened <= keep or total < window)):
        while not open_[by_size[nxt]]:
            nxt += 1
        seed, room, pieces, more = by_size[nxt], window, [], 0
        order = iter((seed,))
        while room and total:
            i = next(order, None)
            if i is None:
                more += 1
                if more == 1:
                    s = index.scores(np.unique(rests[seed]))
                    s[~open_] = 0.0
                    some = min(n, max(8, 3 * room * opened // total))
                    top = np.argpartition(s, n - some)[n - some :]
                    top = top[s[top] > 0]
                    order = iter(top[np.lexsort((top, -s[top]))].tolist())
                elif more == 2:  # the best are used up: the other neighbours follow
                    rest = np.flatnonzero((s > 0) & open_)
                    order = iter(rest[np.lexsort((rest, -s[rest]))].tolist())
                else:  # no neighbour is unused: the longest follow
                    order = iter([j for j in by_size[nxt:] if open_[j]])
                continue
            if not open_[i]:
                continue
            k = min(room, left[i])
            pieces.append((i, at[i], k))
            at[i] += k
            left[i] -= k
            room -= k
            total -= k
            if not left[i]:
                open_[i] = False
                opened -= 1
        out.append(pieces)
    return out, [(i, at[i]) for i in np.flatnonzero(open_).tolist()]


# ---- shards

@lru_cache(1)
def _chance() -> np.ndarray:
    """(draws, terms): for each draw, -log of a uniform number for each term."""
    return np.random.default_rng(20_240_607).exponential(size=(DRAWS, TERMS)).astype(np.float32)


def _distinct(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of each term of each document, by document."""
    key = np.repeat(np.arange(len(docs), dtype=np.uint32) << np.uint32(16), [len(d) for d in docs]) | np.concatenate(docs)
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first] >> np.uint32(16), key[first] & np.uint32(TERMS - 1), np.diff(np.append(first, len(key)))


def keys_of(doc: np.ndarray, term: np.ndarray, count: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """The drawn terms in a row (16 bits each, 48 in all) of n documents that each have a term."""
    weight = idf[term] * count / (count + np.float32(K1)) + np.float32(1e-9)
    first = np.searchsorted(doc, np.arange(n))
    out = np.zeros(n, np.int64)
    for chance in _chance():
        value = chance[term] / weight
        least = np.minimum.reduceat(value, first)
        at = np.flatnonzero(value == least[doc])
        at = at[np.unique(doc[at], return_index=True)[1]]
        out = out << 16 | term[at].astype(np.int64)
    return out


def _salted(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys with 15 bits that tell rows of one key apart, so that ranges can cut a hot key."""
    return key << 15 | (doc * 2_654_435_761 >> 7 & 0x7FFF)


T_SQL = "doc long, id long, ids binary, key long, part int, df binary"


def _fit(rows: DataFrame, tokens_of: Callable[[], Encoder], end: int, window: int, parts: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(idf, first key of each part but the first), from a sample of rows."""
    size = max(SAMPLE, SAMPLE_EACH * parts)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens_of()
        for b in it:
            ids = encoder.batch(b["text"].to_pylist(), end)
            yield pa.RecordBatch.from_arrays([pa.array([x[len(x) // window * window :].astype("<u2").tobytes() for x in ids], pa.binary())], ["ids"])
        encoder.clear()

    some = rows.sample(min(1.0, size / max(1, n)), seed=17) if n > size else rows
    docs = [np.frombuffer(bytes(r["ids"]), "<u2") for r in some.select("text").mapInArrow(run, "ids binary").limit(2 * size).collect()]
    docs = [d for d in docs if len(d)]
    if not docs:
        return np.zeros(TERMS, np.float32), np.zeros(0, np.int64)
    doc, term, count = map(np.concatenate, zip(*[(d + np.uint32(s), t, c) for s in range(0, len(docs), 4_096) for d, t, c in [_distinct(docs[s : s + 4_096])]], strict=True))
    idf = idf_of(np.bincount(term, minlength=TERMS), len(docs)).astype(np.float32)
    keys = np.sort(_salted(keys_of(doc, term, count, idf, len(docs)), np.arange(len(docs))))
    return idf, keys[np.arange(1, parts) * len(keys) // parts]


def packed(docs: DataFrame, vocabulary: str, window: int = WINDOW, end: int = 1, id: str = "doc_id", text: str = "text", shard_docs: int = SHARD_DOCS, then: Kernel | None = None, schema: str = PIECES_SQL) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): one row for each piece; ids as in tokens().

    A piece holds the ids [start, start + length) of its document and lies at offset in its sequence, gapless from 0.
    Null and empty texts are the end id alone. Null ids are packed as well; repeated rows are documents of their own. No
    rows give none. Only the last sequence of a task may be shorter than the window; there are as many tasks as the
    session sets for shuffles, and at least shard_docs documents for each. Other columns are ignored. Vocabularies of
    over 65,536 ids fail. then: a further kernel over the result's batches, and schema: what it returns.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    ship(spark)
    with open(vocabulary, "rb") as f:
        content = sc.broadcast(f.read())
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    n = rows.count()
    parts = max(1, min(partitions(spark), n // shard_docs))
    tokens_of = lambda: Encoder(content.value)
    fitted = sc.broadcast(_fit(rows, tokens_of, end, window, parts, n))

    def keyed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, (idf, firsts) = tokens_of(), fitted.value
        df, length, count_ = np.zeros(TERMS, np.int64), 0, 0
        for b in it:
            for s in range(0, b.num_rows, 256):
                some = b.slice(s, 256)
                ids = encoder.batch(some["text"].to_pylist(), end)
                rests = [x[len(x) // window * window :] for x in ids]
                has = np.flatnonzero([len(x) for x in rests])
                key = np.zeros(len(ids), np.int64)
                if len(has):
                    doc, term, count = _distinct([rests[i] for i in has])
                    df += np.bincount(term, minlength=TERMS)
                    length, count_ = length + int(count.sum()), count_ + len(has)
                    key[has] = keys_of(doc, term, count, idf, len(has))
                key = _salted(key, some["doc"].to_numpy())
                part = np.searchsorted(firsts, key, "right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([some["doc"], some["id"], pa.array([x.astype("<u2").tobytes() for x in ids], pa.binary()), pa.array(key), pa.array(part), pa.nulls(len(ids), pa.binary())], _T)
        encoder.clear()
        all_ = np.concatenate([df, [length, count_]]).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32())], pa.array([all_], pa.binary())], _T)
        trim()

    def added(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TERMS + 2, np.int64)
        for b in it:
            for x in b["df"]:
                total += np.frombuffer(x.as_buffer(), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["df"])

    numbered = rows.select(F.monotonically_increasing_id().alias("doc"), "id", "text")
    held = table(numbered.mapInArrow(keyed, T_SQL), "tokens", compression="zstd")
    sent = held.select("df").where("df is not null").coalesce(SENDERS).mapInArrow(added, "df binary").collect()
    total = sum((np.frombuffer(bytes(r["df"]), np.int64) for r in sent), np.zeros(TERMS + 2, np.int64))
    whole = sc.broadcast((idf_of(total[:TERMS], int(total[-1])), float(total[-2] / max(1, total[-1]))))

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[tuple] = []  # (id, tokens of the document, start, rest)
        part, seq = None, 0

        def windows(keep: int) -> Iterator[pa.RecordBatch]:
            nonlocal open_, seq
            done, left = pack([x[3] for x in open_], window, whole.value, keep)
            out = []
            for pieces in done:
                offset = 0
                for i, start, k in pieces:
                    name, size, first, x = open_[i]
                    out.append((name, first + start, k, x[start : start + k].tobytes(), size, seq, offset))
                    offset += k
                seq += 1
            open_ = [(name, size, first + start, x[start:]) for i, start in left for name, size, first, x in [open_[i]]]
            if out:
                yield rows_of(out)

        for b in it:
            out: list[tuple] = []
            for name, ids, p in zip(b["id"].to_pylist(), b["ids"], b["part"].to_pylist(), strict=True):
                if p != part:
                    if open_:
                        yield from windows(0)
                    part, seq = p, p << 40
                x = np.frombuffer(ids.as_buffer(), "<u2")
                whole_ = len(x) // window * window
                for s in range(0, whole_, window):
                    out.append((name, s, window, x[s : s + window].tobytes(), len(x), seq, 0))
                    seq += 1
                    if len(out) == 256:
                        yield rows_of(out)
                        out = []
                if whole_ < len(x):
                    open_.append((name, len(x), whole_, x[whole_:].copy()))
                    if len(open_) >= shard_docs:
                        yield from windows(max(1, shard_docs // CARRIED))
            if out:
                yield rows_of(out)
        if open_:
            yield from windows(0)
        trim()

    dealt = held.where("df is null").select("doc", "id", "ids", "key", "part").repartitionById(parts, "part").sortWithinPartitions("part", "key", "doc")
    kernel = (lambda it: then(cut(it))) if then else cut
    return dealt.select("id", "ids", "part").mapInArrow(kernel, schema)


_T = ["doc", "id", "ids", "key", "part", "df"]
_COLUMNS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


def rows_of(some: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*some, strict=True), _COLUMNS, strict=True)], [k for k, _ in _COLUMNS])


def digest_kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ids replaced by ids_crc32: of the piece's ids as little-endian unsigned 32-bit integers."""
    for b in it:
        crc = [crc32(np.frombuffer(x.as_buffer(), "<u2").astype("<u4").tobytes()) for x in b["ids"]]
        yield pa.RecordBatch.from_arrays([pa.array(crc, pa.int64()) if c == "ids" else b[c] for c in b.schema.names], ["ids_crc32" if c == "ids" else c for c in b.schema.names])


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """packed(), with digest_kernel over its batches."""
    return packed(docs, vocabulary, then=digest_kernel, schema=PIECES_SQL.replace("ids binary", "ids_crc32 long"))
