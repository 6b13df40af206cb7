"""SimHash near-deduplication with pigeonring filtering.

A fingerprint is the bitwise majority over a text's word shingles. It is cut into segments that lie on a ring. Two
fingerprints within a distance t of each other have a start on that ring from which every run of l segments differs in at
most l*t/m bits (m: segments): a chain whose cumulative differences stay within proportional budgets. Two searches rest on
that:

* ``link_exact`` (few differing bits of a short fingerprint; loses nothing): what a chain leaves unchanged is a set of
  m - t segments, so all such sets are bucket keys; bucket mates are pruned by the chain test before the full distance.
  Buckets beyond a size are resolved through the fingerprints halfway between, 65 for each, with no pairs at all.
* ``link_similar`` (long fingerprints of similar texts): each segment is a bucket key and carries the segments that
  follow it; bucket mates must keep that chain within its budgets before their full fingerprints are fetched and compared.
  ``keep_one`` then compares the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_row, drop, partitions, ship, table, trim
from .components import components

#: Segments of the short fingerprint's ring, and the bucket size up to which pairs are compared.
SEGMENTS, BUCKET = 6, 1_024
#: 64-bit words of the long fingerprint, segments of 16 bits on its ring, segments of a chain.
WORDS, CHAIN = 16, 8
#: Rows of a bucket whose pairs are all candidates at once; that are compared with those of other buckets, or in one go; rows of
#: a bucket in memory at a time.
ALL_PAIRS, GAPS, SQUARE, HELD = 4, 16, 512, 65_536
#: Rows of one part of a bucket that is compared in pairs of parts; pairs sent out at a time.
PART, SENT = 16_384, 1 << 18


# ---- fingerprints

def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 (seed 42) of every n-word shingle of the text in lower case (A-Z only); fewer words: of all of them."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size)[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, ends, strict=True)), np.uint64, len(starts))


def majority(rows: np.ndarray) -> np.ndarray:
    """For each bit of uint64 words (rows, words): is it set in over half of the rows? Counted by carry-save adders."""
    n, planes = len(rows), []
    if n == 0:
        return np.zeros(rows.shape[1], np.uint64)
    while len(rows):
        carries = []
        while len(rows) > 1:
            k = len(rows) // 3 or 1
            a, b = rows[:k], rows[k : 2 * k]
            if len(rows) == 2:
                carries.append(a & b)
                rows = a ^ b
                break
            c, x = rows[2 * k : 3 * k], a ^ b
            carries.append((a & b) | (x & c))
            rows = np.concatenate([x ^ c, rows[3 * k :]])
        planes.append(rows[0])
        rows = np.concatenate(carries) if carries else rows[:0]
    above, even = np.zeros_like(planes[0]), ~np.zeros_like(planes[0])
    for bit, plane in reversed(list(enumerate(planes))):
        if n // 2 >> bit & 1:
            even = even & plane
        else:
            above = above | (even & plane)
            even = even & ~plane
    return above


@lru_cache(1)
def _spread(words: int) -> np.ndarray:
    return np.random.default_rng(words).integers(0, 2**64, (2, 65_536, words), np.uint64)


def fingerprint(text: str | None, n: int, words: int = 1, distinct: bool = False) -> np.ndarray:
    """uint64 words of the SimHash. One word: the hashes' own bits. More: 64 * words bits drawn from each hash."""
    h = shingle_hashes(text, n)
    if distinct:
        h = np.unique(h)
    if words == 1:
        return majority(h[:, None])
    a, b = _spread(words)
    return majority(a[h & 0xFFFF] ^ b[h >> np.uint64(16) & 0xFFFF])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, words: int = 1, distinct: bool = False) -> DataFrame:
    """(id, fp): fp binary, the words in big-endian order. Null and empty texts: zero. Rows with a null id are left out."""
    ship(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps = [fingerprint(t, shingle, words, distinct).astype(">u8").tobytes() for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(fps, pa.binary())], ["id", "fp"])
        trim()

    rows = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).where("id is not null")
    return rows.mapInArrow(run, "id long, fp binary")


# ---- short fingerprints: every pair within a distance

def segment_masks(segments: int = SEGMENTS) -> list[int]:
    """Masks of the 64 bits' segments, in ring order."""
    cuts = [round(64 * i / segments) for i in range(segments + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def chain_ok(diffs: np.ndarray, most: int) -> np.ndarray:
    """diffs (segments, ...) on a ring: is there a start from which every prefix of l segments differs in <= l*most/m bits?"""
    m = len(diffs)
    twice = np.concatenate([diffs, diffs])
    found = np.zeros(diffs.shape[1:], bool)
    for start in range(m):
        ok, total = np.ones(diffs.shape[1:], bool), np.zeros(diffs.shape[1:], np.int64)
        for length in range(1, m + 1):
            total = total + twice[start + length - 1]
            ok &= total * m <= length * most
        found |= ok
    return found


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(p: np.ndarray, q: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the links p-q among n items."""
    root, out = list(range(n)), []
    for u, v in zip(p.tolist(), q.tolist(), strict=True):
        a, b = u, v
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((u, v))
    return out


def link_exact(fps: DataFrame, most: int = 2, segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints (column fp, long) which differ in at most most bits (even)."""
    if most % 2 or not 0 <= most < segments:
        raise ValueError("most must be even and below the number of segments")
    spark = fps.sparkSession
    ship(spark)
    masks = segment_masks(segments)
    keys = [_signed(sum(masks[i] for i in same)) for same in combinations(range(segments), segments - most)]
    sig = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for k, m in enumerate(keys)])).alias("x"))
    sig = sig.select("x.k", "x.v", "fp").repartition(partitions(spark), "k", "v").sortWithinPartitions("k", "v")

    def near(x: np.ndarray) -> list[tuple[int, int]]:
        d = x[:, None] ^ x[None]
        parts = np.stack([np.bitwise_count(d & np.uint64(m)) for m in masks])
        p, q = np.nonzero(np.triu(chain_ok(parts, most), 1))
        full = np.bitwise_count(d[p, q]) <= most
        return _forest(p[full], q[full], len(x))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, n = None, [], 0

        def flush() -> tuple[list[int], list[int | None]]:
            if n > bucket:  # left to the other way, which needs no pairs
                x = np.concatenate(held).tolist() if held else []
                return x, [None] * len(x)
            x = np.concatenate(held)
            links = near(x.view(np.uint64)) if len(x) > 1 else []
            return [int(x[p]) for p, _ in links], [int(x[q]) for _, q in links]

        for batch in it:
            k, v, fp = (batch[c].to_numpy() for c in ("k", "v", "fp"))
            if not len(k):
                continue
            cuts = np.flatnonzero((k[1:] != k[:-1]) | (v[1:] != v[:-1])) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(k)]])
            a: list[int] = []
            b: list[int | None] = []
            last = len(starts) - 1
            for i in np.unique(np.concatenate([[0, last], np.flatnonzero(ends - starts > 1)])).tolist():
                s, e = int(starts[i]), int(ends[i])
                if key != (k[s], v[s]):
                    if held:
                        x, y = flush()
                        a += x
                        b += y
                    key, held, n = (k[s], v[s]), [], 0
                n += e - s
                held.append(fp[s:e])
                if n > bucket:
                    x, y = flush()
                    a += x
                    b += y
                    held = []
                elif i not in (last,):
                    x, y = flush()
                    a += x
                    b += y
                    key, held, n = None, [], 0
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        if held:
            a, b = flush()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    found = table(sig.mapInArrow(run, "a long, b long"), "links")
    ball = [_signed(sum(1 << i for i in bits)) for r in range(most // 2 + 1) for bits in combinations(range(64), r)]
    hot = found.where("b is null").select("a").distinct()
    halfway = hot.select("a", F.explode(F.array(*[F.col("a").bitwiseXOR(F.lit(m)) for m in ball])).alias("c"))
    mates = halfway.groupBy("c").agg(F.collect_list("a").alias("all")).where(F.size("all") > 1)  # at most a ball of them
    mates = mates.select(F.explode("all").alias("a"), F.array_min("all").alias("b")).where("a != b")
    return found.where("b is not null").unionByName(mates)


def near_dups(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, most: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(id, fingerprint, component_id) for every row with an id, under the names doc_id, fingerprint, component_id.

    Texts link if their 64-bit fingerprints differ in at most most bits; component_id is the least id reachable, the row's
    own included. Null and empty texts have fingerprint zero and link like any other. Repeated rows come out repeatedly;
    rows with a null id are left out; no rows give none. Other columns are ignored.
    """
    own = table(fingerprints(docs, id, text, shingle).select("id", F.conv(F.hex("fp"), 16, -10).cast("long").alias("fp")), "fingerprints")
    reps = table(own.groupBy("fp").agg(F.min("id").alias("least")), "fingerprints")
    comps = table(components(link_exact(reps, most, bucket=bucket)), "components")
    of = reps.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    of = table(of, "components")
    joined = of.join(comps.select(F.col("component")).distinct(), "component", "left_semi").groupBy("component").agg(F.min("least").alias("all_least"))
    of = table(of.join(joined, "component", "left").select("fp", F.coalesce("all_least", "least").alias("component_id")), "components")
    return own.join(of, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- long fingerprints: similar texts

def most_bits(similarity: float, bits: int) -> int:
    """Differing bits of a pair of that Jaccard similarity: its cosine is 2j/(1+j); 3.5 standard deviations on top."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * share + 3.5 * np.sqrt(bits * share * (1 - share)))


def link_similar(reps: DataFrame, most: int, words: int = WORDS, chain: int = CHAIN, verify: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(a, b): links between ids (long) whose fingerprints (fp binary of 64 * words bits) differ in at most most bits.

    verify: what keeps those of the pairs (a, b) that are links. A pair is found if one of its 16-bit segments is equal and
    starts a chain within the budgets, on the ring or on one that is shifted by half a segment. For 64 segments and a
    Jaccard similarity of 0.8 about 4 segments of either ring are equal; the more similar, the more.

    First, small buckets send out all pairs within a chain, and large ones each row with the least id that leads it.
    What passes the full check makes components. Then the rows of those buckets that hold more pairs within a chain come
    together again, with their whole fingerprints: all pairs whose ends lie in different components are checked in place.
    So the links connect what all pairs that share a chain would.
    """
    spark = reps.sparkSession
    ship(spark)
    m = 4 * words
    budget = [int(length * most / m) for length in range(chain + 1)]
    keys = 2 * m << 16

    def rings(fp: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The segments of both rings: (rows, m) each."""
        f = np.frombuffer(b"".join(fp), ">u2").reshape(len(fp), m).astype(np.uint64)
        return f, (f << np.uint64(8) & np.uint64(0xFFFF)) | np.roll(f, -1, 1) >> np.uint64(8)

    def keys_of(fp: list[bytes]) -> np.ndarray:
        return np.arange(2 * m) << 16 | np.concatenate(rings(fp), 1).astype(np.int64)

    def signatures(fp: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each segment of both rings: bucket keys, and the segments that follow (c, d)."""
        for shift, g in enumerate(rings(fp)):
            ring = np.concatenate([g, g[:, :chain]], 1)
            for s in range(m):
                follow = [np.zeros(len(fp), np.uint64) for _ in range(2)]
                for k in range(1, chain):
                    follow[(k - 1) // 4] |= ring[:, s + k] << np.uint64(16 * ((k - 1) % 4))
                yield (shift * m + s << 16 | g[:, s].astype(np.int64)).astype(np.int32), *follow

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for key, c, d in signatures(b["fp"].to_pylist()) if b.num_rows else ():
                yield pa.RecordBatch.from_arrays([pa.array(key), b["id"], pa.array(c.view(np.int64)), pa.array(d.view(np.int64))], ["key", "id", "c", "d"])

    def within(c: np.ndarray, d: np.ndarray, e: np.ndarray, f: np.ndarray) -> np.ndarray:
        """The chain test: cumulative differences of the segments that follow an equal one."""
        x, y = c ^ e, d ^ f
        ok = np.bitwise_count(x) <= budget[min(5, chain)]
        for k in range(1, 4):
            ok &= np.bitwise_count(x & np.uint64((1 << 16 * k) - 1)) <= budget[k + 1]
        ok &= np.bitwise_count(x).astype(np.int64) + np.bitwise_count(y) <= budget[chain]
        return ok

    def large(c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """Rows and their leaders, as places, and: are there other pairs within a chain?"""
        if len(c) <= SQUARE:
            p, q = np.nonzero(np.triu(within(c[:, None], d[:, None], c[None], d[None]), 1))
            led, first = np.unique(q, return_index=True)  # in row order, so p is the least
            return led, p[first], len(p) > len(led)
        of = np.full(len(c), -1)
        while (free := np.flatnonzero(of < 0)).size:
            got = free[within(c[free[0]], d[free[0]], c[free], d[free])]
            of[got] = of[free[0]] = free[0]
        led = np.flatnonzero(of != np.arange(len(of)))
        if np.bincount(of).max() > 2:
            return led, of[led], True
        for s in range(0, len(of), 256):
            r = slice(s, s + 256)
            for t in range(s, len(of), 4_096):
                u = slice(t, t + 4_096)
                if (within(c[r][:, None], d[r][:, None], c[None, u], d[None, u]) & (of[r][:, None] != of[None, u])).any():
                    return led, of[led], True
        return led, of[led], False

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        seen = 0  # rows of the last bucket that are no longer held
        for batch in it:
            now = [batch["key"].to_numpy(), batch["id"].to_numpy(), batch["c"].to_numpy().view(np.uint64), batch["d"].to_numpy().view(np.uint64)]
            if not len(now[0]):
                continue
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            last = int(np.searchsorted(now[0], now[0][-1]))  # the last bucket may go on
            before, seen = seen, 0 if last else seen
            if len(now[0]) - last > HELD:  # only its leader is held on: the bucket comes together again
                yield from pairs(*now, before, True)
                seen += len(now[0]) - last - 1
                held = [x[last : last + 1] for x in now]
                continue
            yield from pairs(*[x[:last] for x in now], before, False)
            held = [x[last:] for x in now]
        if held is not None:
            yield from pairs(*held, seen, seen > 0)
        held = None
        trim()

    def pairs(key: np.ndarray, i: np.ndarray, c: np.ndarray, d: np.ndarray, seen: int, more: bool) -> Iterator[pa.RecordBatch]:
        """(least, other, none) for pairs of buckets, (key, rows, whole) for buckets with more. seen: rows of the first bucket
        that came before; more: the last bucket isn't whole."""
        if len(key) < 2 and not seen:
            return
        cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        sizes = np.diff(cuts)
        a, b, marks = [], [], []
        small, found = np.repeat(sizes <= GAPS, sizes), []
        for gap in range(1, GAPS):
            p = np.flatnonzero((key[gap:] == key[:-gap]) & small[gap:])
            if not p.size:
                break
            p = p[within(c[p], d[p], c[p + gap], d[p + gap])]
            found.append((p, p + gap))
        if found:
            p, q = (np.concatenate(x) for x in zip(*found, strict=True))
            of = np.searchsorted(cuts, p, "right") - 1
            each = sizes[of] <= ALL_PAIRS
            a.append(i[p[each]])
            b.append(i[q[each]])
            p, q, of = p[~each], q[~each], of[~each]
            order = np.lexsort((p, q))
            led, first = np.unique(q[order], return_index=True)
            a.append(i[p[order][first]])
            b.append(i[led])
            many, n = np.unique(of, return_counts=True)
            sent = np.bincount(np.searchsorted(cuts, led, "right") - 1, minlength=len(sizes))[many]
            marks += [(int(key[cuts[k]]), int(sizes[k])) for k in many[n > sent].tolist()]
        for k in np.flatnonzero(sizes > GAPS).tolist():
            s, e = cuts[k], cuts[k + 1]
            led, leader, open_ = large(c[s:e], d[s:e])
            a.append(i[s:e][leader])
            b.append(i[s:e][led])
            if open_ and not (more and e == len(key)):
                marks.append((int(key[s]), int(e - s)))
        if seen and len(key):
            marks.append((int(key[0]), seen + int(sizes[0])))
        if more:
            marks.append((int(key[-1]), int(sizes[-1])))
        x, y = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (a, b))
        x, y = np.minimum(x, y), np.maximum(x, y)
        both = np.unique(np.stack([x[x != y], y[x != y]]), axis=1)
        if both.size or marks:
            first = pa.array(np.concatenate([both[0], np.array([k for k, _ in marks], np.int64)]))
            second = pa.array(np.concatenate([both[1], np.array([n for _, n in marks], np.int64)]))
            yield pa.RecordBatch.from_arrays([first, second, pa.array(np.arange(len(first)) >= both.shape[1])], ["a", "b", "bucket"])

    sig = reps.select("id", "fp").mapInArrow(cut, "key int, id long, c long, d long")
    dealt = sig.repartition(partitions(spark), "key").sortWithinPartitions("key", "id")  # the least id leads
    both = table(dealt.mapInArrow(run, "a long, b long, bucket boolean"), "candidates")
    least = both.where("not bucket").groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    first = _passing(least, reps, most, words, verify)
    # parts that a bucket's rows are dealt into, 0 for buckets with no more pairs: as many numbers as there are keys
    parts = np.zeros(keys, np.uint16)
    marked = both.where("bucket").groupBy("a").agg(F.max("b").alias("n")).toArrow()
    parts[marked["a"].to_numpy()] = np.minimum(-(-marked["n"].to_numpy() // PART), 65_535)
    comps = table(components(first), "components")
    label = reps.select("id").join(comps.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("of"))
    rest = both.where("not bucket").select("a", "b").distinct().join(least, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        rest = rest.join(comps.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
    rest = rest.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
    second = _passing(rest, reps, most, words, verify)
    if not len(marked):
        return first.unionByName(second)
    held = spark.sparkContext.broadcast(parts)

    def again(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of marked buckets, each to every pair of parts that its own takes part in."""
        for b in it:
            fp = b["fp"].to_pylist()
            ids, of, whole = b["id"].to_numpy(), b["of"].to_numpy(), pa.array(fp, pa.binary())
            for key in keys_of(fp).T.astype(np.int32) if fp else ():
                n = held.value[key].astype(np.int64)
                at = np.repeat(np.arange(len(ids)), n)
                if not len(at):
                    continue
                own = (ids * 2_654_435_761 >> 16) % np.maximum(n, 1)
                other = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                part = own[at]
                yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(np.minimum(part, other)), pa.array(np.maximum(part, other)), pa.array(part), pa.array(ids[at]), whole.take(pa.array(at)), pa.array(of[at])], ["key", "i", "j", "part", "id", "fp", "of"])
        trim()

    def others(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of a bucket, or of two parts of it, that the full check passes and whose ends lie in different components."""
        left: pa.Table | None = None
        for batch in it:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([left, now]) if left is not None else now
            k, u, v = (now[c].to_numpy() for c in ("key", "i", "j"))
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]) | (u[1:] != u[:-1]) | (v[1:] != v[:-1])) + 1).tolist()]
            for s, e in zip(cuts, cuts[1:], strict=False):
                yield from crossing(now.slice(s, e - s))
            left = now.slice(cuts[-1])
        if left is not None:
            yield from crossing(left)
        left = None
        trim()

    def crossing(t: pa.Table) -> Iterator[pa.RecordBatch]:
        u, v, part, i, of = t["i"][0].as_py(), t["j"][0].as_py(), t["part"].to_numpy(), t["id"].to_numpy(), t["of"].to_numpy()
        if t.num_rows < 2 or (of == of[0]).all():
            return
        fp, here = t["fp"].to_pylist(), t["key"][0].as_py()
        bits, all_, out, n = np.frombuffer(b"".join(fp), np.uint64).reshape(len(i), words), keys_of(fp), [], 0
        left = np.flatnonzero(part == u)
        right = left if u == v else np.flatnonzero(part == v)
        for s in range(0, len(left), 64):
            p = left[s : s + 64]
            q = right[s:] if u == v else right
            for w in np.array_split(q, -(-len(q) // 2_048)) if len(q) else ():
                x, y = np.nonzero(of[p][:, None] != of[None, w])
                if not len(x):
                    continue
                far = np.zeros(len(x), np.int64)
                for k in range(words):
                    far += np.bitwise_count(bits[p, k][x] ^ bits[w, k][y])
                x, y = x[far <= most], y[far <= most]
                meet = all_[p[x]]  # only the first of the marked buckets that both are in sends them out
                meet = np.where((meet == all_[w[y]]) & (held.value[meet] > 0), meet, keys)
                x, y = x[meet.min(1) == here], y[meet.min(1) == here]
                out.append((np.minimum(i[p[x]], i[w[y]]), np.maximum(i[p[x]], i[w[y]])))
                n += len(x)
                if n > SENT:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["a", "b"])
                    out, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["a", "b"])

    signed = reps.select("id", "fp").join(label, "id").select("id", "fp", "of")
    rows = signed.mapInArrow(again, "key int, i long, j long, part long, id long, fp binary, of long")
    rows = rows.repartition(partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    more = rows.mapInArrow(others, "a long, b long").where("a != b").distinct()
    third = table(verify(more) if verify else more, "links")
    return first.unionByName(second).unionByName(third)


def _passing(pairs: DataFrame, reps: DataFrame, most: int, words: int, verify: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Those of the pairs (a, b) whose whole fingerprints are near enough, and that verify leaves."""

    def check(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in it:
            x, y = (np.frombuffer(b"".join(t[c].to_pylist()), np.uint64).reshape(t.num_rows, words) for c in ("x", "y"))
            yield t.select(["a", "b"]).filter(pa.array(np.bitwise_count(x ^ y).sum(1) <= most))
        trim()

    full = pairs.join(reps.select(F.col("id").alias("a"), F.col("fp").alias("x")), "a").join(reps.select(F.col("id").alias("b"), F.col("fp").alias("y")), "b")
    full = full.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")
    return table(verify(full) if verify else full, "links")


#: Ids that may be broadcast when documents are taken out (8 bytes each).
BROADCAST_IDS = 1_000_000


def similar(docs: DataFrame, pairs: DataFrame, id: str, text: str, shingle: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of ids whose texts' distinct shingles have at least that Jaccard similarity."""
    pairs = table(pairs, "pairs")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                sets = [np.unique(shingle_hashes(t, shingle)).tobytes() for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(sets, pa.binary())], ["id", "set"])
        trim()

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in it:
            keep = np.zeros(t.num_rows, bool)
            for k, (x, y) in enumerate(zip(t["x"], t["y"], strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                    continue
                if not len(x):
                    keep[k] = True
                    continue
                x, y = (x, y) if len(x) < len(y) else (y, x)
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep[k] = common >= similarity * (len(x) + len(y) - common)
            yield t.select(["a", "b"]).filter(pa.array(keep))
        trim()

    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).join(ends, "id", "left_semi")
    sets = table(rows.mapInArrow(run, "id long, set binary"), "shingles")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    found = table(both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), "links")
    drop(sets)
    drop(pairs)
    return found


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near copies: of each group that links of at least the similarity connect, the least id stays.

    Equal fingerprints are one; link_similar proposes the other pairs, and their distinct shingles' Jaccard similarity decides. Null and empty texts are equal to each other. Rows with a null
    id stay; rows that repeat an id stay or go together. All columns are kept.
    """
    own = table(fingerprints(docs, id, text, shingle, WORDS, True), "fingerprints")
    reps = table(own.groupBy("fp").agg(F.min("id").alias("id")), "fingerprints")
    verify = lambda pairs: similar(docs, pairs, id, text, shingle, similarity)
    comps = table(components(link_similar(reps, most_bits(similarity, 64 * WORDS), verify=verify)), "components")
    gone = comps.where("node != component").select(F.col("node").alias("gone"))
    copies = own.join(reps.select("fp", F.col("id").alias("least")), "fp").where("id != least").select(F.col("id").alias("gone"))
    kept = table(gone.unionByName(copies).distinct(), "gone")
    for x in (own, reps, comps):
        drop(x)
    small = kept.count() <= BROADCAST_IDS
    rows = as_row(docs, "row").join(F.broadcast(kept) if small else kept, F.col(f"row.`{id}`").cast("long") == F.col("gone"), "left_anti")
    return rows.select(*[F.col(f"row.`{c}`") for c in docs.columns])
