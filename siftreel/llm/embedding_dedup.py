"""Embedding near-deduplication: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Vectors of one label that share a table's bucket are compared by exact cosine in double precision; a pair that shares
several buckets counts in the first one. Large buckets are dealt into chunks, and each pair of chunks is a group of its
own, so no task holds more than two chunks and no pair is lost. A group sends out counts and a spanning forest of its
links, never its pairs. Identical vectors are one vector with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, partitions, ship, table
from .components import components

#: The share of pairs at the threshold that may be missed, rows of a chunk, and how many rows an average bucket should have.
MISSED, CHUNK, BUCKET = 4e-4, 1_024, 256
#: Fewest and most hyperplanes of a table.
FEWEST, MOST = 4, 24
SEED = 20_240_611


def bits_for(rows: int, bucket: int = BUCKET) -> int:
    """Hyperplanes so that unrelated vectors fill buckets of about that many rows, however many vectors a label has."""
    return min(MOST, max(FEWEST, round(np.log2(max(1, rows) / bucket))))


def tables_for(least: float, bits: int, missed: float = MISSED) -> int:
    """Tables so that a pair at cosine `least` shares no bucket with probability `missed` at most. One hyperplane agrees
    with probability 1 - angle / pi; at 0.93 that is 0.880, so 9 tables of 4 hyperplanes do, or 24 of 10, or 50 of 15:
    bytes and time grow as the number of vectors to the power 1.18."""
    agree = (1 - np.arccos(min(1.0, max(-1.0, least))) / np.pi) ** bits
    return max(1, int(np.ceil(np.log(missed) / np.log1p(-agree)))) if agree < 1 else 1


def planes(dim: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim, tables, bits]).standard_normal((dim, tables * bits))


def signatures(x: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """(rows, tables) bucket numbers of double vectors."""
    on = (x @ planes(x.shape[1], tables, bits) >= 0).reshape(len(x), tables, bits)
    return (on * (1 << np.arange(bits))).sum(2).astype(np.int32)


def linked(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of unit vectors have a cosine of at least least."""
    return a @ b.T >= least


def _find(root: list[int], i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def _usable(v: Column) -> Column:
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return v.isNotNull() & fine & F.exists(v, lambda e: e != 0)


def near_dups(
    vectors: DataFrame, least: float = 0.93, id: str = "vec_id", vector: str = "embedding", label: str = "label", bits: int | None = None, missed: float = MISSED, chunk: int = CHUNK
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row with an id; see the module's text for the method.

    Rows with a null label, and vectors that are null, zero, empty or hold null or non-finite components, have no links
    and are their own component. Vectors of different lengths don't meet. Rows that repeat an id and vector count as
    further vectors of that id: the id is returned once for each row. Rows with a null id are left out.
    """
    spark = vectors.sparkSession
    ship(spark)
    of_floats = vectors.schema[vector].dataType.simpleString() == "array<float>"  # half the bytes, the same numbers
    number = "float" if of_floats else "double"
    all_ids = vectors.select(F.col(f"`{id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast(f"array<{number}>").alias("v")).where("vec_id is not null")
    good = all_ids.where(F.col("label").isNotNull() & _usable(F.col("v")))
    own = table(good.select("vec_id", "label", F.xxhash64("v").alias("h"), "v"), "vectors")
    reps = table(own.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "vectors")

    if bits is None:
        bits = bits_for(reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0)
    tables = tables_for(least, bits, missed)
    small = np.uint16 if bits <= 16 else np.int32

    def hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for dim in np.unique(batch["dim"].to_numpy()):
                b = batch.filter(pa.array(batch["dim"].to_numpy() == dim))
                x = b["v"].flatten().to_numpy().astype(np.float64).reshape(b.num_rows, dim)
                sig = signatures(x / np.abs(x).max(1, keepdims=True), tables, bits)
                raw = pa.array([s.tobytes() for s in sig.astype(small)], pa.binary())
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [b["label"], b["dim"], pa.array(np.full(b.num_rows, t, np.int32)), pa.array(sig[:, t]), b["rep"], b["weight"], b["v"], raw],
                        ["label", "dim", "t", "bucket", "rep", "weight", "v", "sig"],
                    )

    kind = reps.schema["label"].dataType.simpleString()
    sig = reps.select("label", F.size("v").alias("dim"), "rep", "weight", "v").mapInArrow(hashed, f"label {kind}, dim int, t int, bucket int, rep long, weight long, v array<{number}>, sig binary")
    key = ["label", "dim", "t", "bucket"]
    large = table(sig.groupBy(*key).count().where(F.col("count") > chunk), "large")
    chunks = F.ceil(F.coalesce("count", F.lit(1)) / chunk).cast("int")
    sig = sig.join(large, key, "left").withColumn("chunks", chunks).withColumn("c", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    sig = sig.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("i", F.least("c", "o")).withColumn("j", F.greatest("c", "o"))
    group = ["dim", "t", "bucket", "i", "j", "label"]  # the label last: it may hold anything

    def compare(t: pa.Table) -> Iterator[tuple]:
        n = t.num_rows
        ids, weight, c, dim = t["rep"].to_numpy(), t["weight"].to_numpy(), t["c"].to_numpy(), t["dim"][0].as_py()
        at, i, j = t["t"][0].as_py(), t["i"][0].as_py(), t["j"][0].as_py()
        x = t["v"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(n, dim)
        x = x / np.abs(x).max(1, keepdims=True)
        x = x / np.sqrt((x * x).sum(1, keepdims=True))
        s = np.frombuffer(b"".join(t["sig"].to_pylist()), small).reshape(n, tables)
        root, links = list(range(n)), np.zeros(n, np.int64)
        first = np.flatnonzero(c == i)
        second = np.flatnonzero(c == j)
        for k in range(0, len(first), 512):
            rows = first[k : k + 512]
            p, q = np.nonzero(linked(x[rows], x[second], least))
            p, q = rows[p], second[q]
            keep = p < q if i == j else p != q
            p, q = p[keep], q[keep]
            if at and len(p):
                new = np.ones(len(p), bool)
                for e in range(at):
                    new &= s[p, e] != s[q, e]
                p, q = p[new], q[new]
            np.add.at(links, p, weight[q])
            np.add.at(links, q, weight[p])
            for u, v in zip(p.tolist(), q.tolist(), strict=True):
                u, v = _find(root, u), _find(root, v)
                if u != v:
                    root[max(u, v)] = min(u, v)
        for u in np.flatnonzero(links).tolist():
            r = _find(root, u)
            yield int(ids[u]), int(links[u]), int(ids[r]) if r != u else None

    def found(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_now, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            if t.num_rows > 1 and (out := list(compare(t))):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "links", "b"])

        for batch in it:
            h = batch["g"].to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(h[1:] != h[:-1]) + 1
            for x, y in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if x == y:
                    continue
                if key_now is not None and key_now != h[x]:
                    yield from flush()
                    held = []
                key_now = h[x]
                held.append(batch.slice(x, y - x))
        if held:
            yield from flush()

    named = sig.withColumn("g", F.concat_ws(":", *group)).select("g", "dim", "t", "i", "j", "c", "rep", "weight", "v", "sig")
    dealt = named.repartition(partitions(spark), "g").sortWithinPartitions("g")
    pairs = table(dealt.mapInArrow(found, "a long, links long, b long"), "links")
    comps = table(components(pairs.where("b is not null").select("a", "b")), "components")
    links = pairs.groupBy("a").agg(F.sum("links").alias("n")).withColumnRenamed("a", "rep")
    of_rep = reps.join(links, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    of_rep = of_rep.select("label", F.col("v").alias("_v"), F.xxhash64("v").alias("h"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    hit = own.join(of_rep, (own["label"] == of_rep["label"]) & (own["h"] == of_rep["h"]) & (own["v"] == of_rep["_v"])).select("vec_id", "n_links", "component_id")
    rest = all_ids.where(F.col("label").isNull() | ~F.coalesce(_usable(F.col("v")), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return hit.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))
