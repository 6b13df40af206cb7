"""Exact top-k search by inner product with a vector-approximation file.

1. Vectors become integers. Of equal vectors only those of the smallest ids can be among a query's best: 2 k rows, k of
   one id at most (which may be the query's own). The others go.
2. The approximation file holds one byte a dimension for each vector: a cell of a grid of equal cells between the least and
   greatest component. Vectors themselves are written beside it and not read again until they are asked for.
3. Queries, in blocks of a bounded size, scan the file. A cell's middle is at most half a cell off, so every score lies
   within a known distance of the approximate one; what can't reach a query's k-th lower bound is left out at once.
4. Exact vectors are read in the order of their bounds, a few for each query, then more, until no bound reaches the k-th
   best score found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, ship, table

#: Numbers of a block of queries (32 bytes for each are broadcast), cells a dimension, rows scanned at a time, vectors
#: read for each query at first (times k), and how many times more in each further round.
BLOCK, CELLS, STEP, FIRST, MORE = 1 << 20, 256, 8_192, 2, 8


class Grid:
    """Equal cells for each dimension: low + width * cell up to the next cell."""

    def __init__(self, low: list[int], high: list[int], cells: int = CELLS):
        self.low = np.array(low, object)
        self.width = np.array([(h - a) // cells + 1 for a, h in zip(low, high, strict=True)], object)
        self.reach = [max(abs(a), abs(h)) for a, h in zip(low, high, strict=True)]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """uint8 cells of int64 vectors."""
        return ((x - self.low.astype(np.int64)) // self.width.astype(np.int64)).astype(np.uint8)

    def bounds(self, cells: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(approximate scores (queries, rows), how far off each query's may be)."""
        width, low = self.width.astype(np.float64), self.low.astype(np.float64)
        q = q.astype(np.float64)
        score = (q * width) @ cells.T.astype(np.float64) + (q @ (low + (width - 1) / 2))[:, None]
        half = np.abs(q) @ ((width - 1) / 2)
        rounding = (np.abs(q) @ (np.abs(low) + width * CELLS)) * (q.shape[1] + 4) * 2.0**-50
        return score, half + rounding + 0.5


class Candidates:
    """What may be among the k best of each query, as far as seen: (query, row, upper bound), and the k best lower bounds."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full((n, k), -np.inf)
        self.query, self.row, self.upper = [np.zeros(0, t) for t in (np.int64, np.int64, np.float64)]

    def add(self, rows: np.ndarray, score: np.ndarray, off: np.ndarray, own: np.ndarray) -> None:
        """own: which (query, row) are the query itself."""
        score = np.where(own, -np.inf, score)
        low = score - off[:, None]
        best = np.concatenate([self.least, low], 1)
        self.least = np.partition(best, best.shape[1] - self.k, axis=1)[:, best.shape[1] - self.k :]
        q, r = np.nonzero((score + off[:, None] >= self.least.min(1)[:, None]) & ~own)
        new = q, rows[r], score[q, r] + off[q]
        self.query, self.row, self.upper = (np.concatenate(x) for x in zip((self.query, self.row, self.upper), new, strict=True))
        keep = self.upper >= self.least.min(1)[self.query]
        self.query, self.row, self.upper = self.query[keep], self.row[keep], self.upper[keep]


def _usable(v: Column) -> Column:
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return v.isNotNull() & fine


def _matrix(v: pa.Array, dim: int) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), dim)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding", scale: float = 1024.0, block: int = BLOCK, first: int = FIRST) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of highest integer inner product, itself left out.

    Components become floor(scale * x) first. Ties go to the smaller id; fewer than k candidates give fewer rows; a
    query without candidates gives none. Null ids and vectors that are null or hold null or non-finite components take
    no part; vectors of different lengths don't meet (empty ones score 0). Repeated ids are rows of their own, but a
    query never meets its own id; a query id that occurs twice is searched once, with its least vector. If a score could
    pass 64 bits an OverflowError says so.
    """
    spark = vectors.sparkSession
    ship(spark)
    whole = lambda df: df.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where(F.col("id").isNotNull() & _usable(F.col("v"))).select(
        "id", F.transform("v", lambda e: F.floor(e * F.lit(scale)).cast("long")).alias("v"), F.size("v").alias("dim")
    )
    rows = whole(vectors)
    for key, most in (("id", k), ("dim", 2 * k)):
        smallest = F.row_number().over(Window.partitionBy(*dict.fromkeys(("dim", "v", key))).orderBy("id"))
        rows = rows.withColumn("n", smallest).where(F.col("n") <= most).drop("n")
    rows = table(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = whole(queries).groupBy("id").agg(F.min(F.struct("v", "dim")).alias("x")).select("id", "x.v", "x.dim")
    asked = table(asked, "queries")
    edges = lambda df: df.select("dim", F.posexplode("v").alias("at", "x")).groupBy("dim", "at").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    found, own = None, {(r["dim"], r["at"]): (r["low"], r["high"]) for r in edges(asked).collect()}
    dims = [r["dim"] for r in asked.select("dim").distinct().collect()]
    lows = {(r["dim"], r["at"]): (r["low"], r["high"]) for r in edges(rows.where(F.col("dim").isin(dims))).collect()} if dims else {}
    for dim in sorted(dims):
        if dim and (dim, 0) not in lows:
            continue
        grid = Grid([lows[dim, d][0] for d in range(dim)], [lows[dim, d][1] for d in range(dim)])
        most = sum(g * max(map(abs, own[dim, d])) for d, g in enumerate(grid.reach))
        if most >= 2**63:
            raise OverflowError(f"scores may reach {most}, which 64 bits don't hold")
        part = _search(rows.where(F.col("dim") == dim), asked.where(F.col("dim") == dim), dim, grid, k, block, first)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return found


def _search(rows: DataFrame, asked: DataFrame, dim: int, grid: Grid, k: int, block: int, first: int) -> DataFrame:
    """top_k for vectors of one length: rows (row, id, v), asked (id, v)."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(grid)

    def approximate(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                cells = held.value.cells(_matrix(b["v"], dim))
                yield pa.RecordBatch.from_arrays([b["row"], b["id"], pa.array([c.tobytes() for c in cells], pa.binary())], ["row", "id", "cells"])

    file = table(rows.select("row", "id", "v").mapInArrow(approximate, "row long, id long, cells binary"), "approximation")
    many = max(1, block // max(1, dim))
    n = asked.count()
    blocks = max(1, -(-n // many))
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")) if blocks > 1 else asked.withColumn("block", F.lit(0))
    bounds = None
    for b in range(blocks):  # a block of queries at a time: as many passes over the file as there are blocks
        mine = numbered.where(F.col("block") == b).select("id", "v").toArrow()
        if not mine.num_rows:
            continue
        sent = spark.sparkContext.broadcast((mine["id"].to_numpy(), _matrix(mine["v"].combine_chunks(), dim)))

        def scan(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            groups = [slice(s, s + 512) for s in range(0, len(ids), 512)]
            kept = [Candidates(len(ids[g]), k) for g in groups]
            for batch in it:
                for s in range(0, batch.num_rows, STEP):
                    some = batch.slice(s, STEP)
                    cells = np.frombuffer(b"".join(some["cells"].to_pylist()), np.uint8).reshape(some.num_rows, dim)
                    name, row = some["id"].to_numpy(), some["row"].to_numpy()
                    for g, c in zip(groups, kept, strict=True):
                        c.add(row, *held.value.bounds(cells, q[g]), ids[g][:, None] == name[None])
            for g, c in zip(groups, kept, strict=True):
                lower = c.least.min(1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[g][c.query]), pa.array(c.row), pa.array(c.upper), pa.array(lower[c.query])], ["query_id", "row", "upper", "lower"])

        part = table(file.mapInArrow(scan, "query_id long, row long, upper double, lower double"), "bounds")
        bounds = part if bounds is None else bounds.unionByName(part)
        sent.unpersist()
    if bounds is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # a task's k-th lower bound holds for all rows: the greatest one prunes what the other tasks sent
    sure = bounds.groupBy("query_id").agg(F.max("lower").alias("sure"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("upper"), "row"))
    left = table(bounds.join(sure, "query_id").where("upper >= sure").select("query_id", "row", "upper", order.alias("n")), "bounds")
    drop(file)
    score = F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    read, at, until = None, 0, first * k
    while True:
        now = left.where((F.col("n") > at) & (F.col("n") <= until))
        if read is not None:  # only what a bound still lets in
            kth = read.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
            now = now.join(kth, "query_id", "left").where("kth is null or upper >= kth").drop("kth")
            if now.isEmpty():
                break
        exact = now.join(rows.select("row", F.col("id").alias("vec_id"), "v"), "row").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
        exact = exact.select("query_id", "vec_id", score.alias("score"))
        both = exact if read is None else read.select("query_id", "vec_id", "score").unionByName(exact)
        read, before = table(both.withColumn("rank", best).where(F.col("rank") <= k), "best"), read
        drop(before)
        at, until = until, until * MORE
    return read.select("query_id", "rank", "vec_id", "score")
