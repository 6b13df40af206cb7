"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector: hashed words (square-root counts, unit length), and a dense part of structure statistics
(shares of kinds of characters, repetition, line shapes) and metadata (length). The machine has a weight and a short
factor for each feature; the sum over all pairs of features is scored in linear time by the sum-of-squares identity,
sum_{i<j} <v_i, v_j> x_i x_j = (|sum_i v_i x_i|^2 - sum_i |v_i x_i|^2) / 2. It is fitted by Adam on a bounded sample of
labelled rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, trim

#: Hashed words, factor length, labelled rows that the fit may use, passes, rows of a step, rate, weight decay.
BUCKETS, RANK, SAMPLE, EPOCHS, BATCH, RATE, DECAY = 1 << 14, 8, 8_000, 6, 128, 0.02, 1e-4
#: Steps that a fit takes at least, by more passes over few rows.
STEPS = 400
#: A document is kept from this score on.
THRESHOLD = 0.3
#: Words whose bucket a task remembers.
MEMO = 300_000

def _kind(c: str) -> int:
    """Upper-case letter, other letter, digit, ordinary mark or space, other symbol."""
    return 0 if c.isupper() else 1 if c.isalpha() else 2 if c.isdigit() else 3 if c.isspace() or c in ".,;:'\"!?()-_" else 4


@lru_cache(1)
def _kinds() -> np.ndarray:
    return np.array([_kind(chr(i)) for i in range(1 << 16)], np.uint8)


STATISTICS = ("upper", "digit", "symbol", "shout", "letter", "distinct", "repeat", "common", "word_length", "lone", "short_line", "line_words", "same_lines", "length", "words", "stop")


def statistics(text: str, words: list[str], counts: Counter, lone: int) -> np.ndarray:
    """Structure statistics and metadata of a whole text, each about 0 to 1; lone: words without a letter or digit."""
    n, w = max(1, len(text)), max(1, len(words))
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    upper, lower, digit, _, symbol = (np.bincount(_kinds()[np.minimum(code, 0xFFFF)], minlength=5) / n).tolist()
    shout = (text.count("!!") + text.count("??")) / n
    lines = [x for x in text.split("\n") if x.strip()] or [""]
    again = sum(map(eq, words, words[1:])) / w
    top = max(counts.values(), default=0) / w
    stop = sum(x[-1] in ".!?:;" for x in lines if x) / len(lines)
    return np.array(
        [
            min(1, 4 * upper), min(1, 10 * digit), min(1, 8 * symbol), min(1, 20 * shout), upper + lower, len(counts) / w, min(1, 2 * again), min(1, 4 * top), min(1, n / w / 15), min(1, 3 * lone / w),
            sum(len(x.split(None, 3)) < 4 for x in lines) / len(lines), min(1, w / len(lines) / 100), 1 - len(set(lines)) / len(lines), min(1, np.log1p(len(text)) / 12), min(1, np.log1p(len(words)) / 10), stop,
        ],
        np.float32,
    )


def bucket(word: str, buckets: int = BUCKETS) -> int:
    return crc32(word.lower().encode("utf-8", "surrogatepass")) % buckets


def features(text: str | None, known: dict[str, int], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values): hashed words first, statistics from `buckets` on. known remembers words: twice the bucket, and
    one more if it has no letter or digit."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    for x in [x for x in counts if x not in known]:
        known[x] = 2 * bucket(x, buckets) + (not any(map(str.isalnum, x)))
    own = np.fromiter(map(known.__getitem__, counts), np.int64, len(counts))
    times = np.fromiter(counts.values(), np.float64, len(counts))
    lone = int(times[own & 1 == 1].sum())
    at, back = np.unique(own >> 1, return_inverse=True)
    x = np.sqrt(np.bincount(back, times, len(at))) if len(at) else np.zeros(0)
    if len(at):
        x /= np.sqrt((x * x).sum())
    return np.concatenate([at, buckets + np.arange(len(STATISTICS))]), np.concatenate([x, statistics(text, words, counts, lone)]).astype(np.float32)


class Machine:
    """w0 + <w, x> + sum of pairwise interactions, through a sigmoid."""

    def __init__(self, size: int, rank: int = RANK, seed: int = 7):
        r = np.random.default_rng(seed)
        self.w0, self.w, self.v = np.float64(0), np.zeros(size), r.normal(0, 0.05, (size, rank))

    def raw(self, at: np.ndarray, x: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores of n rows whose entries (row, feature, value) lie one after another, and their factor sums."""
        first = np.searchsorted(rows, np.arange(n))
        vx = self.v[at] * x[:, None]
        total = np.add.reduceat(vx, first)
        pairs = 0.5 * ((total**2).sum(1) - np.add.reduceat((vx**2).sum(1), first))
        return self.w0 + np.add.reduceat(self.w[at] * x, first) + pairs, total

    def fit(self, data: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, decay: float = DECAY, seed: int = 11) -> Machine:
        r, n = np.random.default_rng(seed), len(data)
        state = {k: [np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))] for k in ("w0", "w", "v")}
        step, even = 0, {y: n / (2 * max(1, (labels == y).sum())) for y in (0, 1)}  # both labels weigh alike
        weight = np.where(labels == 1, even[1], even[0]) ** 0.5
        for _ in range(max(epochs, -(-STEPS * batch // n))):
            order = r.permutation(n)
            for s in range(0, n, batch):
                b = order[s : s + batch]
                size = np.array([len(data[i][0]) for i in b])
                at, x, rows = np.concatenate([data[i][0] for i in b]), np.concatenate([data[i][1] for i in b]).astype(np.float64), np.repeat(np.arange(len(b)), size)
                z, total = self.raw(at, x, rows, len(b))
                g = weight[b] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[b]) / len(b)
                ge = g[rows] * x
                gv = ge[:, None] * (total[rows] - self.v[at] * x[:, None])
                u, back = np.unique(at, return_inverse=True)
                step += 1
                for k, where, grad in (("w0", None, g.sum()), ("w", u, np.bincount(back, ge, len(u))), ("v", u, np.stack([np.bincount(back, gv[:, f], len(u)) for f in range(gv.shape[1])], 1))):
                    m, q = state[k]
                    if where is None:
                        m, q = 0.9 * m + 0.1 * grad, 0.999 * q + 0.001 * grad**2
                        state[k] = [m, q]
                        self.w0 -= rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)
                        continue
                    p = getattr(self, k)
                    grad = grad + decay * p[where]
                    m[where] = 0.9 * m[where] + 0.1 * grad
                    q[where] = 0.999 * q[where] + 0.001 * grad**2
                    p[where] -= rate * (m[where] / (1 - 0.9**step)) / (np.sqrt(q[where] / (1 - 0.999**step)) + 1e-8)
        self.w, self.v = self.w.astype(np.float32), self.v.astype(np.float32)
        return self

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        """One row, by the sum-of-squares identity: linear in its features."""
        vx = self.v[at] * x[:, None]
        total = vx.sum(0, dtype=np.float64)
        z = float(self.w0) + float(self.w[at].astype(np.float64) @ x) + 0.5 * float((total**2).sum() - (vx.astype(np.float64) ** 2).sum())
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text, mod 5, is 0. A null id is not held out, nor learnt from."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, buckets: int = BUCKETS) -> Machine:
    """Fit on at most `sample` labelled rows that aren't held out, of the least hashed ids; only their features reach the driver.

    Labels other than 0 and 1 and null ids don't count; an id with several rows counts with its least text and label.
    Without a label the machine scores 0.5 everywhere.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(known), "id")  # at most `sample` rows

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for b in it:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                at, x = zip(*[features(t, memo, buckets) for t in part["text"].to_pylist()], strict=True)
                if len(memo) > MEMO:
                    memo.clear()
                yield pa.RecordBatch.from_arrays([part["id"], part["y"], pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())), pa.array(list(x), pa.list_(pa.float32()))], ["id", "y", "at", "x"])

    got = rows.select("id", "y", "text").mapInArrow(run, "id long, y int, at array<int>, x array<float>").toArrow()
    best: dict[int, int] = {}
    ids, y = got["id"].to_pylist(), got["y"].to_pylist()
    data = [(np.array(a.values, np.int64), np.array(x.values, np.float32)) for a, x in zip(got["at"], got["x"], strict=True)]
    for k in sorted(range(len(ids)), key=lambda k: (ids[k], data[k][1].tobytes())):
        best.setdefault(ids[k], k)
    order = [best[i] for i in sorted(best)]
    machine = Machine(buckets + len(STATISTICS))
    if order:
        machine.fit([data[k] for k in order], np.array([y[k] for k in order]))
    return machine


def scored(docs: DataFrame, machine: Machine, text: str = "text", buckets: int = BUCKETS, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) with score (double, 0 to 1). Null and empty texts get the score of an empty text; any row is scored."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(machine)  # as large as the hashed space
    kept = [c for c in keep or docs.columns if c != "score"]
    own = f"c{kept.index(text)}" if text in kept else "own"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for b in it:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                scores = [model.value.score(*features(t, memo, buckets)) for t in part[own].to_pylist()]
                if len(memo) > MEMO:
                    memo.clear()
                yield pa.RecordBatch.from_arrays([*[part[f"c{i}"] for i in range(len(kept))], pa.array(scores, pa.float64())], [*[f"c{i}" for i in range(len(kept))], "score"])
        memo.clear()
        trim()

    from pyspark.sql import types as T

    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], *([] if text in kept else [F.col(f"`{text}`").alias(own)]))
    schema = T.StructType([*[T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(kept)], T.StructField("score", T.DoubleType())])
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], "score")
