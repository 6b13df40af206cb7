"""The WebP sanitiser, its chunk table, and header decoding by expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import U64, be_uint, le_uint
from . import webp_walk
from .mp4 import ERR
from .session import ship
from .vp8l import Fault, check_image


#: Rows of chunks that go out together, with those of the file that reaches the number.
CHUNKS = 10_000


def webp_sanitize(files: DataFrame, path: str = "path", content: str = "content", allow_unknown_chunks: bool = False, keep_content: bool = False) -> DataFrame:
    """(path, format, ok, err, metadata, span, displacement, pad_size): the MP4 verdict's columns, the last four null.

    keep_content: the files' bytes stay as column content.
    """
    kept, kinds = ["content"] if keep_content else [], [*[pa.string()] * 3, pa.list_(pa.string())]
    ship(files.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [webp_walk.report(b["content"][k].as_py(), allow_unknown_chunks) for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b["path"], *[pa.array([x[k] for x in found], t) for k, t in enumerate(kinds)], *[b[c] for c in kept]], ["path", "code", "arg", "detail", "stack", *kept])

    rows = files.select(F.col(f"`{path}`").cast("string").alias("path"), F.col(f"`{content}`").alias("content"))
    err = F.when(F.col("code").isNotNull(), F.struct(F.lit("Parse").alias("kind"), "code", "arg", "detail", "stack")).cast(ERR)
    none = {"metadata": "binary", "span": f"struct<offset:{U64},len:{U64}>", "displacement": "int", "pad_size": "bigint"}
    return rows.mapInArrow(run, "path string, code string, arg string, detail string, stack array<string>" + ", content binary" * keep_content).select("path", F.lit("webp").alias("format"), F.col("code").isNull().alias("ok"), err.alias("err"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()], *kept)


def webp_chunks(files: DataFrame, path: str = "path", content: str = "content", allow_unknown_chunks: bool = True) -> DataFrame:
    """(path, ord, depth, pos, name, len): every chunk header, in the order read, up to the first fault."""
    ship(files.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            log: list[dict] = []
            of, ords, data = [], [], b["content"]
            for k in range(b.num_rows):
                before = len(log)
                webp_walk.verdict(data[k].as_py(), allow_unknown_chunks, log)
                of += [k] * (len(log) - before)
                ords += range(len(log) - before)
                if len(log) >= CHUNKS or k == b.num_rows - 1:
                    cols = [pa.array([x[c] for x in log], t) for c, t in (("depth", pa.int32()), ("pos", pa.int64()), ("name", pa.string()), ("len", pa.int64()))]
                    yield pa.RecordBatch.from_arrays([b["path"].take(pa.array(of, pa.int64())), pa.array(ords, pa.int32()), *cols], ["path", "ord", "depth", "pos", "name", "len"])
                    of, ords = [], []
                    log.clear()

    rows = files.select(F.col(f"`{path}`").cast("string").alias("path"), F.col(f"`{content}`").alias("content"))
    return rows.mapInArrow(run, "path string, ord int, depth int, pos long, name string, len long")


def vp8l_header(data: Column, pos: Column | int = 1) -> Column:
    """Struct(signature, width, height, alpha, version) of the five bytes at a 1-based position, by bit arithmetic."""
    at = pos if isinstance(pos, Column) else F.lit(pos)
    v = le_uint(data, at + 1, 4)
    part = lambda shift, n: F.shiftright(v, shift).bitwiseAND(F.lit((1 << n) - 1)).cast("int")
    return F.struct(
        be_uint(data, at, 1).cast("int").alias("signature"), (part(0, 14) + 1).alias("width"), (part(14, 14) + 1).alias("height"), (part(28, 1) == 1).alias("alpha"), part(29, 3).alias("version")
    )


def vp8l_codes(images: DataFrame, id: str = "id", data: str = "data", width: str = "width", height: str = "height") -> DataFrame:
    """(id, ok, code): is the bit stream after the five header bytes valid for an image of that size?"""
    ship(images.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            codes = []
            for raw, w, h in zip(b["data"].to_pylist(), b["width"].to_pylist(), b["height"].to_pylist(), strict=True):
                try:
                    check_image(raw or b"", w or 1, h or 1)
                    codes.append(None)
                except Fault as e:
                    codes.append(e.code)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array([c is None for c in codes]), pa.array(codes, pa.string())], ["id", "ok", "code"])

    rows = images.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{data}`").alias("data"), F.col(f"`{width}`").cast("long").alias("width"), F.col(f"`{height}`").cast("long").alias("height"))
    return rows.mapInArrow(run, "id long, ok boolean, code string")
