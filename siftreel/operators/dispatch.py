"""Format choice and dispatch: each file to the sanitiser of its format."""

from __future__ import annotations

from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import repeated
from .mp4 import ERR, INLINE_PAD, PAD_HEADER, mp4_verdict, mp4_walk
from .mp4_walk import BYTES, FILES, METADATA_LIMIT, WALK_SQL, WALK_TYPES, columns, moved, walk
from .session import ship
from .webp import webp_sanitize
from .webp_walk import report

FORMATS = ("mp4", "webp")


def format_of(path: Column, explicit: Column | None = None) -> Column:
    """The explicit format, else the path's extension without regard to case; null if neither is known."""
    found = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
    guess = F.when(found.isin(*FORMATS), found)
    return guess if explicit is None else F.coalesce(F.lower(explicit), guess)


_FAULT = pa.struct([("code", pa.string()), ("arg", pa.string()), ("detail", pa.string()), ("stack", pa.list_(pa.string()))])
_NO_WALK = dict.fromkeys(WALK_TYPES) | {"boxes": [], "moovs": []}


def _kernel(limit: int, mdat_size: int | None, unknown: bool):
    """A mapInArrow kernel over (path, content, own): own is the format, webp a WebP file's fault, the other columns an MP4
    file's walk. Files of other formats aren't looked into."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            start, walks, faults, held, data, own = 0, [], [], 0, b["content"], b["own"].to_pylist()
            for k, format in enumerate(own):
                raw = data[k].as_py() or b""
                walks.append(moved(walk(BytesIO(raw), len(raw), limit, mdat_size, every=False)) if format == "mp4" else _NO_WALK)
                fault = report(raw, unknown) if format == "webp" else (None,)
                faults.append(None if fault[0] is None else dict(zip(_FAULT.names, fault, strict=True)))
                held += len(walks[-1]["moov"] or b"")
                if len(walks) == FILES or held > BYTES or k == b.num_rows - 1:
                    part = b.slice(start, len(walks))
                    yield pa.RecordBatch.from_arrays([part["path"], part["own"], pa.array(faults, _FAULT), *columns(walks, list(WALK_TYPES))], ["path", "own", "webp", *WALK_TYPES])
                    start, walks, faults, held = k + 1, [], [], 0

    return run


def sanitize(
    files: DataFrame, path: str = "path", content: str = "content", format: str | None = None, max_metadata_size: int = METADATA_LIMIT, cumulative_mdat_box_size: int | None = None, allow_unknown_chunks: bool = False
) -> DataFrame:
    """Verdicts of files of either format: (path, format, ok, err, metadata, span, displacement, pad_size).

    format: a column that names it where the extension should not. Files of no known format get kind Format and code
    UnknownFormat. Null contents are empty files; repeated paths come out repeatedly; other columns are ignored.
    """
    own = format_of(F.col(f"`{path}`").cast("string"), F.col(f"`{format}`") if format else None)
    ship(files.sparkSession)
    # All files go through one kernel: branches by format would each read, or make, every file.
    rows = files.select(F.col(f"`{path}`").cast("string").alias("path"), F.when(own.isin(*FORMATS), F.col(f"`{content}`")).alias("content"), own.alias("own"))
    walked = rows.mapInArrow(_kernel(max_metadata_size, cumulative_mdat_box_size, allow_unknown_chunks), f"path string, own string, webp struct<code string, arg string, detail string, stack array<string>>, {WALK_SQL}")
    out = mp4_verdict(walked, max_metadata_size, keep=("own", "webp"))
    webp = F.when(F.col("webp").isNotNull(), F.struct(F.lit("Parse").alias("kind"), *[F.col(f"webp.{c}").alias(c) for c in ("code", "arg", "detail", "stack")]))
    none = F.struct(F.lit("Format").alias("kind"), F.lit("UnknownFormat").alias("code"), *[F.lit(None).alias(c) for c in ("arg", "detail", "stack")])
    mp4 = F.col("own") == "mp4"
    err = F.when(mp4, F.col("err")).when(F.col("own") == "webp", webp.cast(ERR)).otherwise(none.cast(ERR))
    ok = F.when(mp4, F.col("ok")).otherwise(F.coalesce(F.col("own") == "webp", F.lit(False)) & F.col("webp").isNull())
    return out.select("path", F.col("own").alias("format"), ok.alias("ok"), err.alias("err"), *[F.when(mp4, F.col(c)).alias(c) for c in ("metadata", "span", "displacement", "pad_size")])


def sanitized(
    files: DataFrame, path: str = "path", content: str = "content", format: str | None = None, max_metadata_size: int = METADATA_LIMIT, cumulative_mdat_box_size: int | None = None, allow_unknown_chunks: bool = False
) -> DataFrame:
    """(path, content) of accepted files as they should be passed on: new metadata and the media span, or the file itself.

    One row for each accepted row, repeated paths included; the bytes stay with their verdicts, so nothing is shuffled.
    """
    own = format_of(F.col(f"`{path}`").cast("string"), F.col(f"`{format}`") if format else None)
    rows = files.select(F.col(f"`{path}`").cast("string").alias("path"), F.col(f"`{content}`").alias("content"), own.alias("format"))
    walked = mp4_walk(rows.where(F.col("format") == "mp4"), max_metadata_size=max_metadata_size, cumulative_mdat_box_size=cumulative_mdat_box_size, keep_content=True, every_box=False)
    mp4 = mp4_verdict(walked, max_metadata_size, keep=("content",)).where("ok")
    a, n = (F.col("span")[k].cast("decimal(20,0)") for k in ("offset", "len"))
    raw, size = F.col("content"), F.length("content")
    media = F.substring(raw, F.least(a, size).cast("int") + 1, F.least(n, size).cast("int"))
    zeros = repeated(0, F.when(F.col("pad_size") > INLINE_PAD, F.col("pad_size") - PAD_HEADER).otherwise(F.lit(0)))
    webp = webp_sanitize(rows.where(F.col("format") == "webp"), allow_unknown_chunks=allow_unknown_chunks, keep_content=True).where("ok").select("path", "content")
    return mp4.select("path", F.when(F.col("metadata").isNull(), raw).otherwise(F.concat("metadata", zeros, media)).alias("content")).unionByName(webp)
