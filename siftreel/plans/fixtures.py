"""Media files that are a function of table rows, so that closed-form SQL can say what to expect of them.

One MP4 file for each order: its layout is o_orderkey % 20, its chunk offsets come from the order's line items. One WebP
file for each part: its layout is p_partkey % 17, its width is p_size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binary import le_hex

#: Pieces of each MP4 layout, in file order. M: moov with the order's offsets, D: mdat, f..: a free box of that size.
MP4 = {
    0: "F D M", 1: "F M D", 2: "F f13 D M", 3: "F fM0 D M", 4: "F fM100 D M", 5: "F fM4 D M", 6: "M D", 7: "F F D M", 8: "F D", 9: "F M", 10: "Fmp41 D M", 11: "F D M D", 12: "F D f13 D meta M", 13: "F M U D",
    14: "F D Mnotrak", 15: "F M De", 16: "F D40 M", 17: "F f64 D M1", 18: "F D M cut", 19: "F D Mboth",
}
#: (type, size as constant, times the moov's length, times the mdat's) of each piece; until: its header says to the end.
PIECES = {
    "F": ("ftyp", 20, 0, 0), "Fmp41": ("ftyp", 20, 0, 0), "D": ("mdat", 0, 0, 1), "De": ("mdat", 0, 0, 1), "D40": ("mdat", 40, 0, 0), "M": ("moov", 0, 1, 0), "M1": ("moov", 60, 0, 0), "Mnotrak": ("moov", 16, 0, 0),
    "Mboth": ("moov", 72, 0, 0), "f13": ("free", 13, 0, 0), "f64": ("free", 64, 0, 0), "fM0": ("free", 0, 1, 0), "fM4": ("free", 4, 1, 0), "fM100": ("free", 100, 1, 0), "U": ("uuid", 24, 0, 0), "meta": ("meta", 8, 0, 0),
}
UNTIL_END = ("De", "D40")


def _hex32(n: Column) -> Column:
    return F.lpad(F.hex(n.cast("bigint")), 8, "0")


def _code(name: str) -> str:
    return name.encode().hex().upper()


def _moov(co: Column, co_len: Column) -> Column:
    """Hex of moov > trak > mdia > minf > stbl > co."""
    out, n = co, co_len
    for name in ("stbl", "minf", "mdia", "trak", "moov"):
        n = n + 8
        out = F.concat(_hex32(n), F.lit(_code(name)), out)
    return out


def mp4_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, layout, path, content)."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    items = read("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(order)).alias("items"))
    df = read("orders").select("o_orderkey").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("layout", (F.col("o_orderkey") % 20).cast("int"))
    entries = F.transform(F.coalesce("items", F.array().cast(items.schema["items"].dataType)), lambda i: i["l_partkey"] * 16 + i["l_linenumber"])
    df = df.withColumn("entries", entries).withColumn("wide", F.floor(F.col("o_orderkey") / 20) % 2 == 1)
    n = F.size("entries")
    co_len = 16 + n * F.when(F.col("wide"), 8).otherwise(4)
    digits = F.when(F.col("wide"), 16).otherwise(8)
    co = F.concat(_hex32(co_len), F.when(F.col("wide"), _code("co64")).otherwise(_code("stco")), F.lit("00000000"), _hex32(n), F.array_join(F.transform("entries", lambda e: F.lpad(F.hex(e), digits, "0")), ""))
    df = df.withColumn("moov", _moov(co, co_len)).withColumn("mlen", co_len + 40).withColumn("dlen", 16 + F.col("o_orderkey") % 50)
    empty = F.lit("00000010" + _code("stco") + "00" * 8)
    both = F.concat(empty, F.lit("00000010" + _code("co64") + "00" * 8))
    box = lambda name, size, fill="A5": F.concat(_hex32(size), F.lit(_code(name)), F.repeat(F.lit(fill), (size - 8).cast("int")))
    ftyp = lambda brand: F.lit("00000014" + _code("ftyp") + _code(brand) + "00000000" + _code(brand))
    until = lambda size: F.concat(F.lit("00000000" + _code("mdat")), F.repeat(F.lit("A5"), (size - 8).cast("int")))
    d, m = F.col("dlen"), F.col("mlen")
    piece = {
        "F": ftyp("isom"), "Fmp41": ftyp("mp41"), "D": box("mdat", d), "De": until(d), "D40": until(F.lit(40)), "M": F.col("moov"), "M1": _moov(F.lit("00000014" + _code("stco") + "00" * 4 + "00000001" * 2), F.lit(20)),
        "Mnotrak": F.lit("00000010" + _code("moov") + "00000008" + _code("mvhd")), "Mboth": _moov(both, F.lit(32)), "f13": box("free", F.lit(13), "00"), "f64": box("free", F.lit(64), "00"),
        "fM0": box("free", m, "00"), "fM4": box("free", m + 4, "00"), "fM100": box("free", m + 100, "00"), "U": F.lit("00000018" + _code("uuid") + "00112233445566778899AABBCCDDEEFF"), "meta": F.lit("00000008" + _code("meta")), "cut": F.lit("000000"),
    }
    whole = F.coalesce(*[F.when(F.col("layout") == k, F.concat(*[piece[p] for p in text.split()])) for k, text in MP4.items()])
    return df.select("o_orderkey", "layout", F.col("o_orderkey").cast("string").alias("path"), F.unhex(whole).alias("content"))


def webp_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, layout, path, content)."""
    # Parts are a few bytes each, so their table has fewer splits than the files made of it need tasks.
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size").repartition("p_partkey").withColumn("layout", (F.col("p_partkey") % 17).cast("int"))
    w, h = F.col("p_size") - 1, F.col("p_partkey") % 16  # stored minus one
    chunk = lambda name, hexed, n: F.concat(F.lit(_code(name.ljust(4)) + n.to_bytes(4, "little").hex().upper()), hexed)
    image = lambda version=0: chunk("VP8L", F.concat(F.lit("2F"), le_hex(w + h * 16384 + version * 2**29, 4), F.lit("888808")), 8)
    vp8x = lambda flags, width=w: chunk("VP8X", F.concat(F.lit(f"{flags:02X}000000"), le_hex(width, 3), le_hex(h, 3)), 10)
    vp8, vp8l = chunk("VP8", F.lit("00" * 24), 24), image()
    alph, anim = chunk("ALPH", F.lit("01888808"), 4), chunk("ANIM", F.lit("00" * 6), 6)
    anmf, test = chunk("ANMF", F.concat(F.lit("00" * 16), vp8l), 32), chunk("TeSt", F.lit("0000"), 2)
    layouts: dict[int, list[Column]] = {
        0: [vp8], 1: [vp8l], 2: [vp8x(0), vp8l], 3: [vp8x(0, w + 1), vp8l], 4: [vp8x(0x10), alph, vp8], 5: [vp8x(0x10), alph, vp8l], 6: [vp8x(2), anim, anmf], 7: [vp8x(2), anim], 8: [vp8l], 9: [vp8l], 10: [image(1)],
        11: [vp8l, test], 12: [chunk("VP8", F.lit("00000001"), 3)], 13: [vp8x(1), vp8l], 14: [vp8x(0x20), vp8l], 15: [vp8l], 16: [vp8x(8), vp8l],
    }
    body = F.coalesce(*[F.when(F.col("layout") == k, F.concat(*v)) for k, v in layouts.items()])
    df = df.withColumn("body", F.concat(F.when(F.col("layout") == 9, _code("WEBX")).otherwise(_code("WEBP")), body))
    file = F.concat(F.when(F.col("layout") == 8, _code("RIFX")).otherwise(_code("RIFF")), le_hex(F.length("body") / 2, 4), "body", F.when(F.col("layout") == 15, "00" * 8).otherwise(""))
    return df.select("p_partkey", "layout", F.col("p_partkey").cast("string").alias("path"), F.unhex(file).alias("content"))


def _bits(*fields: tuple[int, int]) -> str:
    """Hex of (value, bits) fields, least significant bit first."""
    out = at = 0
    for value, n in fields:
        out |= value << at
        at += n
    return out.to_bytes((at + 7) // 8, "little").hex().upper()


_ONE = ((1, 1), (0, 1), (0, 1), (0, 1))  # a prefix code with the one symbol 0
_PREDICTOR = ((1, 1), (0, 2), (0, 3), (0, 1), (1, 1), (0, 1), (1, 1))
def _two(symbol: int, alphabet: int) -> tuple[tuple[int, int], ...]:
    """A normal prefix code in which 0 and a later symbol have one bit each, the later one 1. Its code lengths are spelt
    with 1 (bit 0) and with 18 (bit 1): a run of 11 to 138 zeros."""

    def zeros(n: int) -> tuple[tuple[int, int], ...]:
        out: list[tuple[int, int]] = []
        while n:
            run = min(n, 138) if n <= 138 or n >= 138 + 11 else n - 11
            out += [(1, 1), (run - 11, 7)]
            n -= run
        return tuple(out)

    return ((0, 1), (0, 4), (0, 3), (1, 3), (0, 3), (1, 3), (0, 1), (0, 1), *zeros(symbol - 1), (0, 1), *zeros(alphabet - symbol - 1))


_LEFT = ((1, 1), (0, 1), (0, 1), (1, 1))  # a prefix code with the one symbol 1: as a distance, the pixel to the left
_THREE = ((1, 1), (3, 2), (2, 8))  # a table of three colours, a sub-image of three pixels
_REFERS = (*_THREE, (0, 1), *_two(256, 280), *_ONE * 3, *_LEFT)
#: Lossless bit streams and what is wrong with them, by p_partkey modulo their number.
STREAMS = (
    (_bits((0, 3), *_ONE * 5), None),
    (_bits(*_PREDICTOR, (13, 8), *_ONE * 4, (0, 3), *_ONE * 5), None),
    (_bits(*_PREDICTOR, (14, 8), *_ONE * 4, (0, 3), *_ONE * 5), "InvalidInput"),
    (_bits((0, 1), (1, 1), (12, 4)), "InvalidInput"),
    (_bits((1, 1), (2, 2), (1, 1), (2, 2), (0, 3), *_ONE * 5), "InvalidInput"),
    (_bits((0, 3), (0, 1), (0, 4), (2, 3), (0, 9)), "InvalidVp8lPrefixCode"),
    (_bits((0, 3), *_ONE * 3), "TruncatedChunk"),
    (_bits((1, 1), (3, 2), (1, 8), (0, 1), *_ONE * 5, (0, 3), *_ONE * 5), None),
    (_bits((0, 1), (1, 1), (1, 4), (0, 1), *_ONE * 5), None),  # a colour cache of two
    (_bits((0, 2), (1, 1), (7, 3), (0, 1), *_LEFT, *_ONE * 4, *_ONE * 10), None),  # two groups of codes
    (_bits(*_REFERS, (0, 1), (1, 1), (1, 1), (0, 3), *_ONE * 5), None),  # a colour, and twice the one before
    (_bits(*_REFERS, (1, 1), (0, 1), (1, 1), (0, 3), *_ONE * 5), "InvalidInput"),  # one before the first
    (_bits(*_REFERS, (0, 1), (1, 1), (1, 1), (0, 3)), "TruncatedChunk"),
    (_bits(*_THREE, (1, 1), (1, 4), *_two(281, 282), *_ONE * 4, (0, 1), (1, 1), (1, 1), (0, 3), *_ONE * 5), None),  # colours from the cache
)


def stream_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, data, width, height)."""
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("width"), (1 + F.col("p_partkey") % 16).alias("height"))
    return df.withColumn("data", F.coalesce(*[F.when(F.col("id") % len(STREAMS) == k, F.unhex(F.lit(x))) for k, (x, _) in enumerate(STREAMS)]))
