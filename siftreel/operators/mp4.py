"""The MP4 sanitiser as columns over the box walk.

Every rule is a condition on a box; the verdict is the error with the least (box, priority), found without a shuffle by
array functions over a file's boxes. The media span and the padding or displacement are
expressions as well; chunk offsets are moved by the walk, in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import U64, be32, be_u64, be_uint, repeated
from .mp4_walk import FTYP_LIMIT, METADATA_LIMIT, PAD_HEADER, U64_MAX, WALK_SQL, WALK_TYPES, kernel, zero_kernel
from .session import ship

#: Fixed value: the brand that must be among the compatible ones.
BRAND = "69736F6D"
#: Padding up to this size is part of metadata; of a longer one metadata holds the header only.
INLINE_PAD = 1 << 20

#: detail says what was found and what may be; stack names the boxes around the fault as type@offset, the outermost first.
ERR = "struct<kind:string,code:string,arg:string,detail:string,stack:array<string>>"


def _err(code: str, arg: Column | str | None = None, kind: str = "Parse", detail: Column | str | None = None) -> Column:
    a, d = (F.lit(x) if x is None or isinstance(x, str) else x for x in (arg, detail))
    return F.struct(F.lit(kind).alias("kind"), F.lit(code).alias("code"), a.cast("string").alias("arg"), d.cast("string").alias("detail"), F.lit(None).cast("array<string>").alias("stack"))


def _say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def shown(code: Column, uuid: Column | None = None) -> Column:
    """A box type for messages: trimmed text, hex for what isn't ASCII, a UUID in its usual form."""
    raw = F.encode(code, "ISO-8859-1")
    name = F.when(code.rlike("^[\\x00-\\x7F]*$"), F.trim(code)).when(F.is_valid_utf8(raw.cast("string")), F.trim(raw.cast("string"))).otherwise(F.concat(F.lit("0x"), F.lower(F.hex(raw))))
    if uuid is None:
        return name
    h = F.lower(F.hex(uuid))
    return F.when(uuid.isNotNull(), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])).otherwise(name)


def mp4_walk(files: DataFrame, path: str = "path", content: str = "content", max_metadata_size: int = METADATA_LIMIT, cumulative_mdat_box_size: int | None = None, keep_content: bool = False, every_box: bool = True, only: tuple[str, ...] | None = None) -> DataFrame:
    """(path, length, boxes, cut, ftyp, moov, moovs, gap, moved, outside): the top-level boxes of every file, and what is
    needed of ftyp and moov. Chunk offsets in moov are moved already where it lies behind the media.

    keep_content: the files' bytes stay as column content. every_box: boxes that no verdict needs are listed too. only: the
    columns after path that are made; moov is gone into only for those that need it.
    """
    ship(files.sparkSession)
    rows = files.select(F.col(f"`{path}`").cast("string").alias("path"), F.col(f"`{content}`").alias("content"))
    kept = {"path": "string"} | ({"content": "binary"} if keep_content else {})
    schema = ", ".join([*[f"{c} {t}" for c, t in kept.items()], WALK_SQL if only is None else ", ".join(f"{c} {WALK_TYPES[c]}" for c in only)])
    return rows.mapInArrow(kernel(list(kept), "content", max_metadata_size, cumulative_mdat_box_size, every_box, None if only is None else list(only)), schema)


def mp4_boxes(walked: DataFrame) -> DataFrame:
    """One row for each top-level box: (path, ord, pos, header_len, size, kind, type, uuid)."""
    return walked.select("path", F.explode("boxes").alias("b")).select("path", "b.*")


def _rules(b: Column, max_metadata_size: int) -> Column:
    """The first rule that a box breaks, or null. Needs the columns of _spans."""
    dec = lambda x: F.lit(str(x)).cast(U64)
    small = b["size"].isNotNull() & (b["size"] < b["header_len"])
    there = F.col("length") - b["pos"] - b["header_len"]
    data_len = F.coalesce(b["size"] - b["header_len"], there)
    over = b["size"].isNotNull() & (b["pos"] + b["size"] > dec(U64_MAX))
    io = _err("InvalidData", None, "Io", "the box ends beyond 2^64 - 1")
    bad = _err("InvalidInput", detail=_say("size ", b["size"], " is less than the header's ", b["header_len"], " bytes"))
    large = lambda most: _err("InvalidInput", detail=_say("payload of ", data_len, f" bytes, at most {most} are read"))
    short = _err("TruncatedBox", detail=_say("payload of ", data_len, " bytes, ", there, " are there"))
    brands = F.col("ftyp")
    n_brands = F.floor((F.length(brands) - 8) / 4).cast("int")
    isom = F.exists(F.when(n_brands > 0, F.sequence(F.lit(0), n_brands - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.hex(F.substring(brands, i * 4 + F.lit(9), F.lit(4))) == BRAND)
    inner = F.filter("moovs", lambda m: (m["ord"] == b["ord"]) & m["code"].isNotNull())
    of_ftyp = (
        F.when(b["ord"] > F.col("ftyp_ord"), _err("InvalidBoxLayout", detail="a second ftyp box"))
        .when(small, bad)
        .when(data_len > FTYP_LIMIT, large(FTYP_LIMIT))
        .when(data_len > there, short)
        .when(data_len < 8, _err("TruncatedBox", detail=_say("major brand and minor version take 8 bytes, ", data_len, " are there")))
        .when(~isom, _err("UnsupportedFormat", shown(F.decode(F.substring(brands, 1, 4), "ISO-8859-1")), detail="isom is not among the compatible brands"))
    )
    of_mdat = F.when(small, bad).when(over, io).when(b["ord"] > F.col("stop_ord"), _err("UnsupportedBoxLayout", detail="media data on both sides of a moov box"))
    of_moov = (
        F.when(small, bad)
        .when(data_len > dec(max_metadata_size), large(max_metadata_size))
        .when(data_len > there, short)
        .when(F.size(inner) > 0, F.struct(F.lit("Parse").alias("kind"), inner[0]["code"].alias("code"), *[inner[0][c].alias(c) for c in ("arg", "detail", "stack")]))
    )
    skipped = F.when(small, bad).when(over, io)
    kind = b["type"]
    return (
        F.when(kind.isin("free", "skip"), skipped)
        .when(kind == "ftyp", of_ftyp)
        .when(F.col("ftyp_ord").isNull() | (b["ord"] < F.col("ftyp_ord")), _err("InvalidBoxLayout", detail="a box other than free and skip before ftyp"))
        .when(kind == "mdat", of_mdat)
        .when(kind == "moov", of_moov)
        .when(kind.isin("meta", "meco"), skipped)
        .otherwise(F.coalesce(skipped, _err("UnsupportedBox", shown(kind, b["uuid"]), detail="no such box is known at the top level")))
    )


def _spans(walked: DataFrame) -> DataFrame:
    """The first ftyp and mdat, the moov that ends the media span, the last moov, and the span."""
    first = lambda name: F.array_min(F.transform(F.filter("boxes", lambda b: b["type"] == name), lambda b: b["ord"]))
    end = F.lit(None).cast(U64)
    out = walked.withColumns({"ftyp_ord": first("ftyp"), "mdat_ord": first("mdat")}).withColumns(
        {
            "stop_ord": F.array_min(F.transform(F.filter("boxes", lambda b: (b["type"] == "moov") & (b["ord"] > F.col("mdat_ord"))), lambda b: b["ord"])),
            "moov_ord": F.array_max(F.transform(F.filter("boxes", lambda b: b["type"] == "moov"), lambda b: b["ord"])),
        }
    )
    at = lambda ord: F.get("boxes", ord)["pos"]
    last = F.element_at("boxes", -1)
    end = F.when(F.col("stop_ord").isNotNull(), at(F.col("stop_ord"))).otherwise(F.when(last["size"].isNull(), F.col("length")).otherwise(last["pos"] + last["size"]).cast("decimal(21,0)"))
    return out.withColumn("offset", at(F.col("mdat_ord"))).withColumn("len", F.when(F.col("mdat_ord").isNotNull(), end - F.col("offset")).cast(U64))


def _entries(t: Column) -> Column:
    """The chunk offsets of a table, DECIMAL(20,0)."""
    one = lambda i: F.when(t["width"] == 4, be_uint(F.col("moov"), t["at"] + i * 4 + F.lit(1), 4).cast(U64)).otherwise(be_u64(F.col("moov"), t["at"] + i * 8 + F.lit(1)))
    return F.transform(F.when(t["n"] > 0, F.sequence(F.lit(0), t["n"] - 1)).otherwise(F.array().cast("array<int>")), one)


def mp4_verdict(walked: DataFrame, max_metadata_size: int = METADATA_LIMIT, keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, format, ok, err, metadata, span, displacement, pad_size) of every walked file.

    err is null for an accepted file; its stack is empty or null where no box is at fault. metadata is null where there is
    nothing to change, else the new ftyp and moov, and padding where it fits; span is where the media data lies. Of several moov boxes the last one counts. The walk must
    have had the same max_metadata_size. Padding may come to 4 GiB: beyond INLINE_PAD bytes metadata ends with the header
    of the free box, and pad_size - 8 zero bytes are to follow it. keep: further columns of walked to pass on.
    """
    df = _spans(walked)
    errors = F.transform("boxes", lambda b: F.struct(b["ord"].alias("ord"), _rules(b, max_metadata_size).alias("err")))
    found = F.concat(F.filter(errors, lambda e: e["err"].isNotNull()), F.when(F.col("cut"), F.array(F.struct(F.size("boxes").alias("ord"), _err("TruncatedBox", detail="the file ends in a box header").alias("err")))).otherwise(F.array().cast(f"array<struct<ord:int,err:{ERR}>>")))
    missing = F.coalesce(*[F.when(F.col(f"{n}_ord").isNull(), _err("MissingRequiredBox", n, detail=f"the file has no {n} box")) for n in ("ftyp", "moov", "mdat")])
    df = df.withColumn("first", F.array_min(found)).withColumn("at", F.get("boxes", F.col("first.ord")))
    outer = F.when(F.col("at").isNotNull(), F.array(F.concat(shown(F.col("at.type"), F.col("at.uuid")), F.lit("@"), F.col("at.pos").cast("string")))).otherwise(F.array().cast("array<string>"))
    stack = F.concat(outer, F.coalesce(F.col("first.err.stack"), F.array().cast("array<string>")))
    placed = F.when(F.col("first").isNotNull(), F.struct(*[F.col(f"first.err.{c}").alias(c) for c in ("kind", "code", "arg", "detail")], stack.alias("stack")))
    df = df.withColumn("err", F.coalesce(placed, missing)).drop("first", "at")
    long = lambda x: x.cast("decimal(30,0)")
    fine = F.col("err").isNull()
    # The walk has moved the offsets of every file whose moov lies behind its media; a faulty file's are not used.
    df = df.withColumns({"gap": F.when(fine, long(F.col("gap"))), "moved": F.when(fine, long(F.col("moved")))})
    df = df.withColumn("pad", F.when(F.col("moved") == 0, F.col("gap")).otherwise(F.lit(0)))
    far = ~F.col("moved").between(-(2**31) + 1, 2**31 - 1)
    late = F.when(F.col("moved") != 0, F.when(far, _err("UnsupportedBoxLayout", detail=_say("chunk offsets would move by ", F.col("moved"), ", which 32 bits do not hold"))).when(F.col("outside"), _err("InvalidInput", detail=_say("a chunk offset that moves by ", F.col("moved"), " leaves its field"))))
    df = df.withColumn("err", F.coalesce("err", late))
    fine = F.col("err").isNull()
    free = F.when(F.col("pad") > 0, F.concat(be32(F.col("pad")), F.encode(F.lit("free"), "ISO-8859-1"), repeated(0, F.when(F.col("pad") <= INLINE_PAD, F.col("pad") - PAD_HEADER).otherwise(F.lit(0))))).otherwise(F.lit(b""))
    box = lambda name, data: F.concat(be32(F.length(data) + 8), F.encode(F.lit(name), "ISO-8859-1"), data)
    metadata = F.when(fine & F.col("gap").isNotNull(), F.concat(box("ftyp", F.col("ftyp")), box("moov", F.col("moov")), free))
    span = F.when(fine, F.struct(F.col("offset").cast(U64).alias("offset"), F.col("len").alias("len")))
    # A filter over these columns would be pushed down through every step above, each of which is used several times, and
    # grow without bound. What isn't deterministic stays where it is.
    here = F.spark_partition_id() >= 0
    changed = fine & F.col("gap").isNotNull() & here
    return df.select(
        "path", F.lit("mp4").alias("format"), (fine & here).alias("ok"), F.when(here, F.col("err")).alias("err"), F.when(here, metadata).alias("metadata"), F.when(here, span).alias("span"),
        F.when(changed, F.col("moved").cast("int")).alias("displacement"), F.when(changed, F.col("pad").cast("bigint")).alias("pad_size"), *keep,
    )


def mp4_sanitize(files: DataFrame, path: str = "path", content: str = "content", max_metadata_size: int = METADATA_LIMIT, cumulative_mdat_box_size: int | None = None) -> DataFrame:
    """mp4_verdict of files given as (path, content)."""
    return mp4_verdict(mp4_walk(files, path, content, max_metadata_size, cumulative_mdat_box_size, every_box=False), max_metadata_size)


def mp4_track_stats(walked: DataFrame) -> DataFrame:
    """(path, traks, chunks) of each file's last moov that could be parsed."""
    m = F.element_at(F.filter("moovs", lambda m: m["code"].isNull()), -1)
    return walked.where(F.exists("moovs", lambda m: m["code"].isNull())).select("path", F.size(m["tables"]).alias("traks"), F.aggregate(m["tables"], F.lit(0).cast("bigint"), lambda a, t: a + t["n"]).alias("chunks"))


def mp4_chunk_offsets(verdicts: DataFrame, max_metadata_size: int = METADATA_LIMIT) -> DataFrame:
    """(path, trak, i, chunk_offset): the chunk offsets in rewritten metadata."""
    again = mp4_walk(verdicts.where(F.col("metadata").isNotNull()).select("path", F.col("metadata").alias("content")), max_metadata_size=max_metadata_size)
    t = again.select("path", "moov", F.posexplode(F.element_at("moovs", -1)["tables"]).alias("trak", "t"))
    return t.select("path", "trak", F.posexplode(_entries(F.col("t"))).alias("i", "chunk_offset"))


def mp4_zeroed(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, content): every box kept, mdat payloads replaced by as many zero bytes."""
    ship(files.sparkSession)
    rows = files.select(F.col(f"`{path}`").cast("string").alias("path"), F.col(f"`{content}`").alias("content"))
    return rows.mapInArrow(zero_kernel, "path string, content binary")
