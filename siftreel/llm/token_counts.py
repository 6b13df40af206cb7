"""Greedy word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie. Every node has a failure link and the number of pieces popped on the way to it, so a word is
read once, character by character, and its pieces are counted without being built. A word that the vocabulary can't
cover is one unknown token, as in word-piece models.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Words whose counts a task remembers.
MEMO = 400_000


class Automaton:
    """first: pieces that begin a word; rest: pieces that continue one. An empty first piece is a bare word start."""

    def __init__(self, first: Iterable[str], rest: Iterable[str]):
        first = list(first)
        self.next: list[dict[str, int]] = [{}, {}]  # node 0: word start; node 1: between pieces
        piece = [False, False]
        self.depth = [0, 0]
        for root, pieces in ((0, first), (1, rest)):
            for p in pieces:
                at = root
                for c in p:
                    if c not in self.next[at]:
                        self.next[at][c] = len(self.next)
                        self.next.append({})
                        piece.append(False)
                        self.depth.append(self.depth[at] + 1)
                    at = self.next[at][c]
                if at != root:
                    piece[at] = True
        self.fail, self.pops = [-1] * len(self.next), [0] * len(self.next)
        if "" in first:  # counts as a piece where no other begins the word
            self.fail[0], self.pops[0] = 1, 1
        order = [0, 1]
        for u in order:
            for c, v in self.next[u].items():
                order.append(v)
                if piece[v]:  # the whole node is a piece: pop it, go on between pieces
                    self.fail[v], self.pops[v] = 1, 1
                else:
                    z, popped = self.fail[u], self.pops[u]
                    while z >= 0 and c not in self.next[z]:
                        popped += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = self.next[z][c], popped

    def count(self, word: str) -> int:
        """Pieces of the greedy longest match; 0 if the word can't be covered."""
        at, n, nxt, fail, pops = 0, 0, self.next, self.fail, self.pops
        for c in word:
            while c not in nxt[at]:
                n += pops[at]
                at = fail[at]
                if at < 0:
                    return 0
            at = nxt[at][c]
        while at != 1:
            if at < 1:
                return 0
            n += pops[at]
            at = fail[at]
        return n


#: Marks pieces that begin a word in vocabulary files of this kind.
WORD_START = "▁"


def vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Pieces of a sentence-piece model file that begin (bare start: empty) and that continue a word; control and byte pieces are left out."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    return [p[1:] for p in own if p.startswith(WORD_START)], [p for p in own if WORD_START not in p]


@lru_cache(2)
def _automaton(content: tuple[tuple[str, ...], tuple[str, ...]]) -> Automaton:
    return Automaton(*content)


def token_counts(docs: DataFrame, first: list[str], rest: list[str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, n_tokens, n_unknown): words between white space, word-piece tokens, and words that are unknown.

    Null and empty texts count 0; a null id stays null; repeated rows come out repeatedly; no rows give none. Words of
    any length are read in full, in time linear in their length.
    """
    spark = docs.sparkSession
    ship(spark)
    pieces = spark.sparkContext.broadcast((tuple(first), tuple(rest)))  # as large as the vocabulary

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, known = _automaton(pieces.value).count, {}
        for b in it:
            words, tokens, unknown = [], [], []
            for t in b["text"].to_pylist():
                w = t.split() if t else []
                if len(known) > MEMO:
                    known.clear()
                for x in set(w).difference(known):
                    known[x] = count(x)
                each = list(map(known.__getitem__, w))
                none = each.count(0)
                words.append(len(w))
                tokens.append(sum(each) + none)
                unknown.append(none)
            yield pa.RecordBatch.from_arrays([b["id"], *[pa.array(x, pa.int64()) for x in (words, tokens, unknown)]], [id, "n_words", "n_tokens", "n_unknown"])

    rows = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, f"`{id}` long, n_words long, n_tokens long, n_unknown long")
