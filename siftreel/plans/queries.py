"""Registered queries over the fixtures, and closed-form SQL that says what they must return."""

from __future__ import annotations

from collections.abc import Callable
from uuid import UUID

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.structs import FTYP, VP8X, decode, decode_box, encode, encode_box
from ..operators import mp4, webp
from ..operators.dispatch import format_of, sanitize, sanitized
from .fixtures import MP4, PIECES, STREAMS, UNTIL_END, mp4_fixtures, stream_fixtures, webp_fixtures

#: A box type of a user's own.
USER_TYPE = UUID("6f9619ff-8b86-d011-b42d-00cf4fc964ff")
USER_BOX = (("version_and_flags", "const:00000000"), ("brand", "fourcc"), ("items", ("counted", (("key", (("line", "u8"), ("supplier", "u32"))), ("reserved", "zero:1"), ("part", "u32")))))


def _key(name: str = "o_orderkey") -> Column:
    return F.col("path").cast("bigint").alias(name)


def _part() -> Column:
    return _key("p_partkey")


def _error() -> list[Column]:
    return [F.col("err.kind").alias("kind"), F.col("err.code").alias("code"), F.col("err.arg").alias("arg")]


def _span() -> list[Column]:
    return [F.col("span.offset").cast("bigint").alias("span_offset"), F.col("span.len").cast("bigint").alias("span_len")]


def _verdicts(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return mp4.mp4_sanitize(mp4_fixtures(spark, sf_dir), **options)


def mp4_box_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = mp4.mp4_boxes(mp4.mp4_walk(mp4_fixtures(spark, sf_dir), only=("boxes",)))
    return boxes.select(_key(), "ord", F.col("pos").cast("bigint").alias("pos"), F.col("size").cast("bigint").alias("size"), "header_len", "kind", "type")


def mp4_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).select(_key(), "ok", *_error())


def _why() -> list[Column]:
    return [F.col("err.detail").alias("detail"), F.array_join("err.stack", "/").alias("stack")]


def mp4_error_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each file, and in which boxes."""
    return _verdicts(spark, sf_dir).select(_key(), *_why())


def webp_error_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.webp_sanitize(webp_fixtures(spark, sf_dir)).select(_part(), *_why())


def mp4_user_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box type of a user's own: each order's line items as an array of structures below a UUID, written and read."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.struct(F.struct(F.col("l_linenumber").cast("long").alias("line"), F.col("l_suppkey").cast("long").alias("supplier")).alias("key"), F.col("l_partkey").cast("long").alias("part")).alias("item"))
    value = F.struct(F.lit("item").alias("brand"), F.sort_array(F.collect_list("item")).alias("items"))
    boxes = items.groupBy("l_orderkey").agg(value.alias("value")).select("l_orderkey", encode_box(F.col("value"), USER_TYPE, USER_BOX).alias("data"))
    back = boxes.select("l_orderkey", F.length("data").cast("bigint").alias("n_bytes"), F.lower(F.hex(F.substring("data", 1, 40))).alias("head"), decode_box(F.col("data"), USER_TYPE, USER_BOX).alias("d"))
    total = lambda get: F.aggregate("d.value.items", F.lit(0).cast("bigint"), lambda a, i: a + get(i))
    return back.select("l_orderkey", "n_bytes", "head", F.col("d.code").alias("code"), total(lambda i: i["part"]).alias("parts"), total(lambda i: i["key"]["supplier"]).alias("suppliers"))


def mp4_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).where("ok").select(_key(), *_span())


def mp4_cumulative_mdat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mp4.mp4_sanitize(mp4_fixtures(spark, sf_dir), cumulative_mdat_box_size=40).select(_key(), "ok", *_span(), "displacement")


def mp4_pad_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).where("metadata is not null").select(_key(), "displacement", "pad_size")


def mp4_chunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("chunk_offset").cast("bigint")
    return mp4.mp4_chunk_offsets(_verdicts(spark, sf_dir)).groupBy("path").agg(F.count("*").alias("n"), F.sum(e).alias("total"), F.min(e).alias("least"), F.max(e).alias("most")).select(_key(), "n", "total", "least", "most")


def mp4_metadata_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).where("metadata is not null").select(_key(), F.length("metadata").cast("bigint").alias("n_bytes"), F.sha2(F.hex("metadata").cast("binary"), 256).alias("hex_sha256"))


def mp4_sanitized_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = mp4_fixtures(spark, sf_dir).withColumn("format", F.lit("mp4"))
    again = mp4.mp4_sanitize(sanitized(files, format="format"))
    return again.select(_key(), "ok", F.col("metadata").isNull().alias("nothing_to_do"))


def mp4_track_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mp4.mp4_track_stats(mp4.mp4_walk(mp4_fixtures(spark, sf_dir), only=("moovs",))).select(_key(), "traks", "chunks")


def mp4_media_zeroed(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = mp4.mp4_zeroed(mp4_fixtures(spark, sf_dir))
    boxes = mp4.mp4_walk(files, keep_content=True, only=("length", "boxes"))
    media = lambda b: F.hex(F.substring(F.col("content"), b["pos"].cast("int") + 9, F.coalesce(b["size"], F.col("length") - b["pos"]).cast("int") - 8))
    none = F.forall(F.filter("boxes", lambda b: b["type"] == "mdat"), lambda b: media(b).rlike("^(00)+$"))
    return boxes.select(_key(), F.length("content").cast("bigint").alias("n_bytes"), none.alias("no_media"))


def mp4_ftyp_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    walked = mp4.mp4_walk(mp4_fixtures(spark, sf_dir), only=("ftyp",)).where("ftyp is not null").select("path", decode(F.col("ftyp"), FTYP).alias("d"))
    v = F.col("d.value")
    return walked.select(_key(), v["major_brand"].alias("major_brand"), v["minor_version"].alias("minor_version"), F.array_join(v["compatible_brands"], ",").alias("brands"), F.lower(F.hex(encode(v, FTYP))).alias("encoded"))


def webp_vp8x_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of files whose first chunk is VP8X; the others have no bytes to decode."""
    data = F.when(F.substring("content", 13, 4) == F.lit(b"VP8X"), F.substring(F.col("content"), 21, 10))
    files = webp_fixtures(spark, sf_dir).select("p_partkey", data.alias("data"), decode(data, VP8X, big=False, truncated="TruncatedChunk").alias("d"))
    v = F.col("d.value")
    same = F.coalesce(encode(v, VP8X, big=False) == F.col("data"), F.lit(False))
    return files.select("p_partkey", F.col("d.code").alias("code"), v["flags"].alias("flags"), v["canvas_width"].alias("canvas_width"), v["canvas_height"].alias("canvas_height"), same.alias("encodes_back"))


def webp_chunk_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = webp_fixtures(spark, sf_dir)
    return webp.webp_chunks(files).select(_part(), "ord", "depth", "pos", F.trim("name").alias("name"), "len")


def _webp(unknown: bool) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: webp.webp_sanitize(webp_fixtures(spark, sf_dir), allow_unknown_chunks=unknown).select(_part(), "ok", *_error())


def webp_vp8l_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of files whose first chunk is a lossless image; nulls for the others."""
    files = webp_fixtures(spark, sf_dir)
    data = F.when(F.substring("content", 13, 4) == F.lit(b"VP8L"), F.col("content"))
    return files.select("p_partkey", webp.vp8l_header(data, 21).alias("h")).select("p_partkey", "h.*")


def webp_vp8l_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.vp8l_codes(stream_fixtures(spark, sf_dir)).withColumnRenamed("id", "p_partkey")


def format_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds of files under names that tell the format, hide it, or tell nothing."""
    name = lambda key, layout, ext: F.concat(F.lit("/in.d/"), ext, F.lit("-"), key.cast("string"), F.when(layout % 3 == 0, F.concat(F.lit("."), ext)).when(layout % 3 == 1, F.concat(F.lit("."), F.upper(ext))).otherwise(F.lit(".bin")))
    told = lambda layout, ext: F.when(layout % 6 == 2, ext)

    def named(df: DataFrame, key: str, ext: Column) -> DataFrame:
        return df.select(name(F.col(key), F.col("layout"), ext).alias("path"), "content", told(F.col("layout"), ext).alias("told"))

    files = named(mp4_fixtures(spark, sf_dir), "o_orderkey", F.lit("mp4")).unionByName(named(webp_fixtures(spark, sf_dir), "p_partkey", F.lit("webp")))
    return sanitize(files, format="told").select("path", "format", "ok", F.col("err.code").alias("code"))


def format_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat("p_type", F.when(F.col("p_partkey") % 4 == 0, ".Mp4").when(F.col("p_partkey") % 4 == 1, ".webp").when(F.col("p_partkey") % 4 == 2, ".mp4.gz").otherwise("")).alias("path"))
    return names.select("p_partkey", format_of(F.col("path")).alias("format"))


def ext_verdict_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: how many files of each format and verdict."""
    both = _verdicts(spark, sf_dir).select("format", "err.code").unionByName(webp.webp_sanitize(webp_fixtures(spark, sf_dir)).select("format", "err.code"))
    return both.groupBy("format", "code").agg(F.count("*").alias("files"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "mp4_box_walk": mp4_box_walk, "mp4_verdict": mp4_verdict, "mp4_span": mp4_span, "mp4_cumulative_mdat": mp4_cumulative_mdat, "mp4_pad_displacement": mp4_pad_displacement, "mp4_chunk_offsets": mp4_chunk_offsets,
    "mp4_metadata_hash": mp4_metadata_hash, "mp4_sanitized_roundtrip": mp4_sanitized_roundtrip, "mp4_track_stats": mp4_track_stats, "mp4_media_zeroed": mp4_media_zeroed, "mp4_ftyp_fields": mp4_ftyp_fields, "webp_vp8x_fields": webp_vp8x_fields, "webp_chunk_walk": webp_chunk_walk,
    "webp_verdict": _webp(False), "webp_unknown_chunks": _webp(True), "webp_vp8l_header": webp_vp8l_header, "webp_vp8l_codes": webp_vp8l_codes, "format_dispatch": format_dispatch, "format_guess": format_guess,
    "ext_verdict_rollup": ext_verdict_rollup, "mp4_error_stack": mp4_error_stack, "webp_error_stack": webp_error_stack, "mp4_user_boxes": mp4_user_boxes,
}

# ---- closed-form SQL

_ORDERS = """
    items AS (SELECT l_orderkey, count(*) AS n, sum(l_partkey * 16 + l_linenumber) AS total, min(l_partkey * 16 + l_linenumber) AS least, max(l_partkey * 16 + l_linenumber) AS most,
                     string_agg(printf('%08X', l_partkey * 16 + l_linenumber), '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS narrow,
                     list(l_partkey * 16 + l_linenumber ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS entries FROM lineitem GROUP BY l_orderkey),
    o AS (SELECT o_orderkey, (o_orderkey % 20)::INTEGER AS layout, (o_orderkey // 20) % 2 = 1 AS wide, coalesce(n, 0) AS n, total, least, most, coalesce(entries, []) AS entries,
                 56 + coalesce(n, 0) * CASE WHEN (o_orderkey // 20) % 2 = 1 THEN 8 ELSE 4 END AS m, 16 + o_orderkey % 50 AS d
          FROM orders LEFT JOIN items ON l_orderkey = o_orderkey)"""
_CHANGED = "(0, 2, 3, 4, 5, 12)"
_MOVED = "CASE layout WHEN 0 THEN m WHEN 2 THEN m - 13 WHEN 5 THEN -4 WHEN 12 THEN m ELSE 0 END"
_PAD = "CASE layout WHEN 4 THEN 100 ELSE 0 END"
_MP4_CODE = """CASE layout WHEN 6 THEN 'InvalidBoxLayout' WHEN 7 THEN 'InvalidBoxLayout' WHEN 8 THEN 'MissingRequiredBox' WHEN 9 THEN 'MissingRequiredBox' WHEN 10 THEN 'UnsupportedFormat' WHEN 11 THEN 'UnsupportedBoxLayout'
    WHEN 13 THEN 'UnsupportedBox' WHEN 14 THEN 'MissingRequiredBox' WHEN 16 THEN 'MissingRequiredBox' WHEN 17 THEN 'InvalidInput' WHEN 18 THEN 'TruncatedBox' WHEN 19 THEN 'InvalidBoxLayout' END"""
_MP4_ARG = "CASE layout WHEN 8 THEN 'moov' WHEN 9 THEN 'mdat' WHEN 10 THEN 'mp41' WHEN 13 THEN '00112233-4455-6677-8899-aabbccddeeff' WHEN 14 THEN 'trak' WHEN 16 THEN 'moov' END"
_WEBP_CODE = """CASE p_partkey % 17 WHEN 3 THEN 'InvalidInput' WHEN 5 THEN 'InvalidChunkLayout' WHEN 7 THEN 'MissingRequiredChunk' WHEN 8 THEN 'InvalidChunkLayout' WHEN 9 THEN 'InvalidInput' WHEN 10 THEN 'UnsupportedVp8lVersion'
    {unknown} WHEN 12 THEN 'InvalidInput' WHEN 13 THEN 'InvalidInput' WHEN 14 THEN 'InvalidChunkLayout' WHEN 15 THEN 'InvalidInput' WHEN 16 THEN 'MissingRequiredChunk' END"""
_WEBP_ARG = "CASE p_partkey % 17 WHEN 7 THEN 'ANMF' WHEN 10 THEN '1' {unknown} WHEN 16 THEN 'EXIF' END"
_NOT_KNOWN = {False: ("WHEN 11 THEN 'UnsupportedChunk'", "WHEN 11 THEN 'TeSt'"), True: ("", "")}


def _layout_rows() -> str:
    """(layout, ord, type, constant, moovs, mdats, until) of every piece that is a box; until: 1 to the end of the file."""
    out = []
    for k, text in MP4.items():
        pieces = [p for p in text.split() if p in PIECES]
        for ord, p in enumerate(pieces):
            out.append(f"({k}, {ord}, '{PIECES[p][0]}', {PIECES[p][1]}, {PIECES[p][2]}, {PIECES[p][3]}, {int(p in UNTIL_END)})")
            if p in UNTIL_END:
                break
    return ", ".join(out)


def _webp_sql(unknown: bool) -> str:
    code, arg = (x.format(unknown=u) for x, u in zip((_WEBP_CODE, _WEBP_ARG), _NOT_KNOWN[unknown], strict=True))
    return f"SELECT p_partkey, code IS NULL AS ok, CASE WHEN code IS NOT NULL THEN 'Parse' END AS kind, code, arg FROM (SELECT p_partkey, {code} AS code, {arg} AS arg FROM part)"


def _chunk_rows() -> str:
    """(layout, ord, depth, pos, name, len): all chunks of the accepted layouts, those up to the fault of the others."""
    x, l8 = [(1, 12, "VP8X", 10)], lambda at: (1, at, "VP8L", 8)
    lists = {0: [(1, 12, "VP8", 24)], 1: [l8(12)], 2: [*x, l8(30)], 4: [*x, (1, 30, "ALPH", 4), (1, 42, "VP8", 24)], 6: [*x, (1, 30, "ANIM", 6), (1, 44, "ANMF", 32), (2, 68, "VP8L", 8)], 11: [l8(12), (1, 28, "TeSt", 2)]}
    lists |= {5: [*x, (1, 30, "ALPH", 4), l8(42)], 7: [*x, (1, 30, "ANIM", 6)], 8: [], 9: [], 12: [(1, 12, "VP8", 3)], 13: x} | dict.fromkeys((10, 15), lists[1]) | dict.fromkeys((3, 14, 16), lists[2])
    sizes = {0: 36, 4: 66, 5: 50, 6: 76, 7: 36, 11: 30, 12: 16} | dict.fromkeys((1, 8, 9, 10, 15), 20) | dict.fromkeys((2, 3, 13, 14, 16), 38)
    return ", ".join(f"({k}, {i}, {d}, {p}, '{n}', {s})" for k, v in lists.items() for i, (d, p, n, s) in enumerate([(0, 0, "RIFX" if k == 8 else "RIFF", sizes[k]), *v]))


_DISPATCH = """
    SELECT '/in.d/' || ext || '-' || key || CASE layout % 3 WHEN 0 THEN '.' || ext WHEN 1 THEN '.' || upper(ext) ELSE '.bin' END AS path, CASE WHEN layout % 3 < 2 OR layout % 6 = 2 THEN ext END AS format,
           CASE WHEN layout % 3 < 2 OR layout % 6 = 2 THEN code ELSE 'UnknownFormat' END AS code"""

ORACLES: dict[str, str] = {
    "mp4_box_walk": f"""
        WITH {_ORDERS}, pieces(layout, ord, type, c, cm, cd, until) AS (VALUES {_layout_rows()}),
        sized AS (SELECT o_orderkey, ord, type, until, c + cm * m + cd * d AS size FROM o JOIN pieces USING (layout))
        SELECT o_orderkey, ord, (sum(size) OVER (PARTITION BY o_orderkey ORDER BY ord) - size)::BIGINT AS pos, CASE WHEN until = 0 THEN size END::BIGINT AS size, CASE type WHEN 'uuid' THEN 24 ELSE 8 END AS header_len,
               CASE until WHEN 1 THEN 'eof' ELSE 'u32' END AS kind, type FROM sized""",
    "mp4_verdict": f"WITH {_ORDERS} SELECT o_orderkey, code IS NULL AS ok, CASE WHEN code IS NOT NULL THEN 'Parse' END AS kind, code, arg FROM (SELECT o_orderkey, {_MP4_CODE} AS code, {_MP4_ARG} AS arg FROM o)",
    "mp4_span": f"""
        WITH {_ORDERS} SELECT o_orderkey, (CASE layout WHEN 0 THEN 20 WHEN 1 THEN 20 + m WHEN 2 THEN 33 WHEN 3 THEN 20 + m WHEN 4 THEN 120 + m WHEN 5 THEN 24 + m WHEN 12 THEN 20 WHEN 15 THEN 20 + m END)::BIGINT AS span_offset,
               (CASE layout WHEN 12 THEN 2 * d + 21 ELSE d END)::BIGINT AS span_len FROM o WHERE layout IN (0, 1, 2, 3, 4, 5, 12, 15)""",
    "mp4_cumulative_mdat": f"""
        WITH {_ORDERS}, x AS (SELECT *, layout IN (0, 1, 2, 3, 4, 5, 12, 16) OR layout = 15 AND d <= 40 AS ok FROM o)
        SELECT o_orderkey, ok, CASE WHEN ok THEN CASE layout WHEN 1 THEN 20 + m WHEN 2 THEN 33 WHEN 3 THEN 20 + m WHEN 4 THEN 120 + m WHEN 5 THEN 24 + m WHEN 15 THEN 20 + m ELSE 20 END END::BIGINT AS span_offset,
               CASE WHEN ok THEN CASE layout WHEN 12 THEN 2 * d + 21 WHEN 15 THEN 40 WHEN 16 THEN 40 ELSE d END END::BIGINT AS span_len,
               CASE WHEN layout = 16 THEN m WHEN layout IN {_CHANGED} THEN {_MOVED} END::INTEGER AS displacement FROM x""",
    "mp4_pad_displacement": f"WITH {_ORDERS} SELECT o_orderkey, ({_MOVED})::INTEGER AS displacement, ({_PAD})::BIGINT AS pad_size FROM o WHERE layout IN {_CHANGED}",
    "mp4_chunk_offsets": f"""
        WITH {_ORDERS}, x AS (SELECT *, {_MOVED} AS moved FROM o WHERE layout IN {_CHANGED} AND n > 0)
        SELECT o_orderkey, n, (total + n * moved)::BIGINT AS total, (least + moved)::BIGINT AS least, (most + moved)::BIGINT AS most FROM x""",
    "mp4_metadata_hash": f"""
        WITH {_ORDERS}, x AS (SELECT *, {_MOVED} AS moved, {_PAD} AS pad FROM o WHERE layout IN {_CHANGED}),
        h AS (SELECT o_orderkey, 20 + m + pad AS n_bytes,
                     upper('0000001466747970' || '69736f6d0000000069736f6d' || printf('%08x', m) || '6d6f6f76' || printf('%08x', m - 8) || '7472616b' || printf('%08x', m - 16) || '6d646961' || printf('%08x', m - 24) || '6d696e66'
                     || printf('%08x', m - 32) || '7374626c' || printf('%08x', m - 40) || CASE WHEN wide THEN '636f3634' ELSE '7374636f' END || '00000000' || printf('%08x', n)
                     || array_to_string(list_transform(entries, lambda e: CASE WHEN wide THEN printf('%016x', (e + moved)::BIGINT) ELSE printf('%08x', (e + moved)::BIGINT) END), '')
                     || CASE WHEN pad > 0 THEN printf('%08x', pad) || '66726565' || repeat('00', pad - 8) ELSE '' END) AS hexed FROM x)
        SELECT o_orderkey, n_bytes::BIGINT AS n_bytes, sha256(hexed) AS hex_sha256 FROM h""",
    "mp4_sanitized_roundtrip": "SELECT o_orderkey, true AS ok, true AS nothing_to_do FROM orders WHERE o_orderkey % 20 IN (0, 1, 2, 3, 4, 5, 12, 15)",
    "mp4_track_stats": f"WITH {_ORDERS} SELECT o_orderkey, 1 AS traks, (CASE layout WHEN 17 THEN 1 ELSE n END)::BIGINT AS chunks FROM o WHERE layout NOT IN (8, 14, 16, 19)",
    "mp4_media_zeroed": f"""
        WITH {_ORDERS}, pieces(layout, ord, type, c, cm, cd, until) AS (VALUES {_layout_rows()})
        SELECT o_orderkey, (sum(c + cm * m + cd * d) + CASE layout WHEN 16 THEN m ELSE 0 END)::BIGINT AS n_bytes, true AS no_media FROM o JOIN pieces USING (layout) GROUP BY o_orderkey, layout, m""",
    "mp4_ftyp_fields": """
        SELECT o_orderkey, brand AS major_brand, 0::BIGINT AS minor_version, brand AS brands, hexed || '00000000' || hexed AS encoded
        FROM (SELECT o_orderkey, CASE o_orderkey % 20 WHEN 10 THEN 'mp41' ELSE 'isom' END AS brand, CASE o_orderkey % 20 WHEN 10 THEN '6d703431' ELSE '69736f6d' END AS hexed FROM orders WHERE o_orderkey % 20 <> 6)""",
    "webp_vp8x_fields": """
        WITH p AS (SELECT p_partkey, p_size, (p_partkey % 17)::INTEGER AS layout FROM part)
        SELECT p_partkey, CASE WHEN layout = 13 THEN 'InvalidInput' WHEN layout NOT IN (2, 3, 4, 5, 6, 7, 14, 16) THEN 'TruncatedChunk' END AS code, CASE layout WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN 16 WHEN 5 THEN 16 WHEN 6 THEN 2 WHEN 7 THEN 2 WHEN 14 THEN 32 WHEN 16 THEN 8 END::INTEGER AS flags,
               CASE WHEN layout IN (2, 4, 5, 6, 7, 14, 16) THEN p_size WHEN layout = 3 THEN p_size + 1 END::BIGINT AS canvas_width, CASE WHEN layout IN (2, 3, 4, 5, 6, 7, 14, 16) THEN 1 + p_partkey % 16 END::BIGINT AS canvas_height,
               layout IN (2, 3, 4, 5, 6, 7, 14, 16) AS encodes_back
        FROM p""",
    "webp_chunk_walk": f"""
        WITH chunks(layout, ord, depth, pos, name, len) AS (VALUES {_chunk_rows()})
        SELECT p_partkey, ord, depth, pos::BIGINT AS pos, name, len::BIGINT AS len FROM part JOIN chunks ON layout = p_partkey % 17""",
    "webp_verdict": _webp_sql(False),
    "webp_unknown_chunks": _webp_sql(True),
    "webp_vp8l_header": "WITH p AS (SELECT *, p_partkey % 17 IN (1, 8, 9, 10, 11, 15) AS image FROM part) SELECT p_partkey, CASE WHEN image THEN 47 END AS signature, CASE WHEN image THEN p_size END AS width, CASE WHEN image THEN 1 + p_partkey % 16 END::INTEGER AS height, "
    "CASE WHEN image THEN false END AS alpha, CASE WHEN image THEN CASE p_partkey % 17 WHEN 10 THEN 1 ELSE 0 END END AS version FROM p",
    "webp_vp8l_codes": "SELECT p_partkey, code IS NULL AS ok, code FROM (SELECT p_partkey, CASE p_partkey % " + str(len(STREAMS)) + " " + " ".join(f"WHEN {k} THEN '{c}'" for k, (_, c) in enumerate(STREAMS) if c) + " END AS code FROM part)",
    "format_dispatch": f"""
        WITH {_ORDERS}, files AS (SELECT 'mp4' AS ext, o_orderkey AS key, layout, {_MP4_CODE} AS code FROM o UNION ALL SELECT 'webp', p_partkey, (p_partkey % 17)::INTEGER, {_WEBP_CODE.format(unknown=_NOT_KNOWN[False][0])} FROM part),
        named AS ({_DISPATCH} FROM files)
        SELECT path, format, code IS NULL AS ok, code FROM named""",
    "format_guess": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'mp4' WHEN 1 THEN 'webp' END AS format FROM part",
    "ext_verdict_rollup": f"""
        WITH {_ORDERS}, v AS (SELECT 'mp4' AS format, {_MP4_CODE} AS code FROM o UNION ALL SELECT 'webp', {_WEBP_CODE.format(unknown=_NOT_KNOWN[False][0])} FROM part)
        SELECT format, code, count(*) AS files FROM v GROUP BY format, code""",
    "mp4_error_stack": f"""
        WITH {_ORDERS} SELECT o_orderkey,
               CASE layout WHEN 6 THEN 'a box other than free and skip before ftyp' WHEN 7 THEN 'a second ftyp box' WHEN 8 THEN 'the file has no moov box' WHEN 9 THEN 'the file has no mdat box' WHEN 10 THEN 'isom is not among the compatible brands'
                           WHEN 11 THEN 'media data on both sides of a moov box' WHEN 13 THEN 'no such box is known at the top level' WHEN 14 THEN 'no trak box' WHEN 16 THEN 'the file has no moov box'
                           WHEN 17 THEN 'a chunk offset that moves by -4 leaves its field' WHEN 18 THEN 'the file ends in a box header' WHEN 19 THEN 'stco and co64 in one sample table' END AS detail,
               CASE layout WHEN 6 THEN 'moov@0' WHEN 7 THEN 'ftyp@20' WHEN 10 THEN 'ftyp@0' WHEN 11 THEN 'mdat@' || (20 + d + m) WHEN 13 THEN '00112233-4455-6677-8899-aabbccddeeff@' || (20 + m) WHEN 14 THEN 'moov@' || (20 + d) WHEN 18 THEN ''
                           WHEN 19 THEN 'moov@' || (20 + d) || '/trak@' || (28 + d) || '/mdia@' || (36 + d) || '/minf@' || (44 + d) || '/stbl@' || (52 + d) END AS stack
        FROM o""",
    "webp_error_stack": """
        WITH p AS (SELECT p_partkey, p_partkey % 17 AS layout, p_size AS w, 1 + p_partkey % 16 AS h FROM part)
        SELECT p_partkey,
               CASE layout WHEN 3 THEN 'an image of ' || w || ' x ' || h || ' on a canvas of ' || (w + 1) || ' x ' || h WHEN 5 THEN 'expected VP8, found VP8L' WHEN 7 THEN 'a frame is expected at 44' WHEN 8 THEN 'expected RIFF, found RIFX'
                           WHEN 9 THEN 'expected WEBP, found WEBX' WHEN 10 THEN 'version 1, only 0 is known' WHEN 11 THEN 'unknown chunks are not allowed' WHEN 12 THEN 'the padding byte at 23 is not zero'
                           WHEN 13 THEN 'flags 0x01 of 0x3e, reserved bytes 000000, canvas of ' || w || ' x ' || h WHEN 14 THEN 'expected ICCP, found VP8L' WHEN 15 THEN 'bytes after the file''s end at 28' WHEN 16 THEN 'EXIF is expected at 46' END AS detail,
               CASE layout WHEN 3 THEN 'RIFF@0/VP8L@30' WHEN 5 THEN 'RIFF@0/VP8L@42' WHEN 7 THEN 'RIFF@0/ANIM@30' WHEN 8 THEN 'RIFX@0' WHEN 9 THEN 'RIFF@0' WHEN 10 THEN 'RIFF@0/VP8L@12' WHEN 11 THEN 'RIFF@0/TeSt@28' WHEN 12 THEN 'RIFF@0/VP8@12'
                           WHEN 13 THEN 'RIFF@0/VP8X@12' WHEN 14 THEN 'RIFF@0/VP8L@30' WHEN 15 THEN '' WHEN 16 THEN 'RIFF@0/VP8L@30' END AS stack
        FROM p""",
    "mp4_user_boxes": f"""
        SELECT l_orderkey, (36 + 10 * count(*))::BIGINT AS n_bytes, printf('%08x', 36 + 10 * count(*)) || '75756964{USER_TYPE.hex}000000006974656d' || printf('%08x', count(*)) || printf('%02x', min(l_linenumber)) || printf('%06x', (min(l_linenumber * 4294967296 + l_suppkey) % 4294967296 // 256)::BIGINT) AS head,
               NULL::VARCHAR AS code, sum(l_partkey)::BIGINT AS parts, sum(l_suppkey)::BIGINT AS suppliers
        FROM lineitem GROUP BY l_orderkey""",
}
