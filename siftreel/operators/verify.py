"""Verification of rewritten MP4 files: the media that chunk offsets point to, before and after."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mp4_walk import METADATA_LIMIT, plain, walk
from .session import ship

#: Bytes that are compared at each chunk offset.
SAMPLE = 64


def _samples(data: bytes, limit: int, sample: int) -> list[list[tuple[int, bytes | None]]] | None:
    """The chunk offsets of each track of a file's last moov, and up to sample bytes there, no further than the box that
    they are in (None beyond the end); None if the file has no moov that can be parsed."""
    found = plain(walk(BytesIO(data), len(data), limit, None))
    good = [m for m in found["moovs"] if m["code"] is None]
    if not good or found["moov"] is None:
        return None
    moov, starts = bytes(found["moov"]), [int(b["pos"]) for b in found["boxes"]]
    ends = [*starts[1:], len(data)]

    def at(p: int) -> tuple[int, bytes | None]:
        return p, data[p : min(p + sample, ends[bisect_right(starts, p) - 1])] if p < len(data) else None

    return [[at(p) for p in np.frombuffer(moov, f">u{t['width']}", t["n"], t["at"]).tolist()] for t in good[-1]["tables"]]


def mp4_compare_media(pairs: DataFrame, path: str = "path", before: str = "before", after: str = "after", sample: int = SAMPLE, max_metadata_size: int = METADATA_LIMIT) -> DataFrame:
    """(path, chunks, moved, same): how many chunk offsets the rewritten file has, how many differ from the original's,
    and whether as many tracks and chunks are there and each offset finds the bytes that it found before.

    sample bytes are compared at each offset, or fewer up to the end of its box; one beyond the end must be so in both. Files without a moov that
    can be parsed, before or after, give nulls; null contents are empty files. One row in, one row out, no shuffle.
    """
    ship(pairs.sparkSession)

    def one(old: bytes, new: bytes) -> tuple[int | None, int | None, bool | None]:
        a, b = _samples(old, max_metadata_size, sample), _samples(new, max_metadata_size, sample)
        if a is None or b is None:
            return None, None, None
        x, y = [o for t in a for o in t], [o for t in b for o in t]
        same = [len(t) for t in a] == [len(t) for t in b] and [found for _, found in x] == [found for _, found in y]
        return len(y), sum(p != q for (p, _), (q, _) in zip(x, y, strict=False)), same

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = [one(x or b"", y or b"") for x, y in zip(b["before"].to_pylist(), b["after"].to_pylist(), strict=True)]
            columns = zip(*got, strict=True) if got else ([], [], [])
            yield pa.RecordBatch.from_arrays([b["path"], *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_()), strict=True)]], ["path", "chunks", "moved", "same"])

    rows = pairs.select(F.col(f"`{path}`").cast("string").alias("path"), F.col(f"`{before}`").alias("before"), F.col(f"`{after}`").alias("after"))
    return rows.mapInArrow(run, "path string, chunks long, moved long, same boolean")
