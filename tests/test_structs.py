from uuid import UUID

import pytest
from media import bits, box
from pyspark.sql import functions as F

from siftreel.functions import structs as S
from siftreel.functions.structs import box_header, checked_add, decode, encode

CASES = [
    (S.FTYP, True, b"isom\0\0\2\0isommp42", (None, ("isom", 512, ["isom", "mp42"]))),
    (S.FTYP, True, b"isom\0\0\2\0isomxy", (None, ("isom", 512, ["isom"]))),
    (S.FTYP, True, b"isom\0\0\2", ("TruncatedBox", None)),
    (S.STCO, True, bytes(4) + b"\0\0\0\2\0\0\0\7\xff\xff\xff\xff", (None, ([7, 2**32 - 1],))),
    (S.STCO, True, bytes(8), (None, ([],))),
    (S.STCO, True, b"\1" + bytes(7), ("InvalidInput", None)),
    (S.STCO, True, bytes(4) + b"\0\0\0\1", ("TruncatedBox", None)),
    (S.STCO, True, bytes(12), ("InvalidInput", None)),
    (S.STCO, True, bytes(4) + b"\x40\0\0\0", ("InvalidInput", None)),
    (S.CO64, True, bytes(4) + b"\0\0\0\1" + b"\xff" * 8, (None, ([2**64 - 1],))),
    (S.FULL_BOX, True, b"\1\0\0\3", (None, (1, 3))),
    (S.FULL_BOX, True, b"\1\0\0\3\0", ("InvalidInput", None)),
    (S.FULL_BOX, True, None, ("TruncatedBox", None)),
    (S.CHUNK, False, b"XMP \1\2\0\0", (None, ("XMP ", 513))),
    (S.WEBP, False, b"WEBP", (None, (True,))),
    (S.WEBP, False, b"WEBX", ("InvalidInput", None)),
    (S.VP8X, False, b"\x10\0\0\0" + bits((299, 24), (2**24 - 1, 24)), (None, (16, 300, 2**24))),
    (S.VP8X, False, b"\x01\0\0\0" + bytes(6), ("InvalidInput", None)),
    (S.VP8X, False, b"\x10\0\1\0" + bytes(6), ("InvalidInput", None)),
    (S.ALPH, False, b"\x1d", (None, (0x1D,))),
    (S.ALPH, False, b"\x02", ("InvalidInput", None)),
    (S.ANIM, False, b"\xfe\xc4\xce\xfa\x0f\xf0", (None, (0xFACEC4FE, 0xF00F))),
    (S.ANMF, False, bits((1, 24), (2, 24), (3, 24), (4, 24), (0xC0FFEE, 24), (3, 8)), (None, (1, 2, 4, 5, 0xC0FFEE, 3))),
    ((("a", "i8"), ("b", "i16"), ("c", "i32"), ("d", "i64"), ("e", "bytes:2")), True, b"\xff" * 15 + b"xy", (None, (-1, -1, -1, -1, bytearray(b"xy")))),
]


def plain(x):
    return None if x is None else tuple([int(v) for v in y] if isinstance(y, list) and y and not isinstance(y[0], str) else y if isinstance(y, str | bytes | bytearray | list | bool) else int(y) for y in x)


@pytest.mark.parametrize("fields, big, data, want", CASES)
def test_decode_encode(spark, fields, big, data, want):
    df = spark.createDataFrame([(data and bytearray(data),)], "data binary").select("data", decode(F.col("data"), fields, big).alias("d"))
    row = df.select("d.code", "d.value", encode(F.col("d.value"), fields, big).alias("back")).first()
    assert (row["code"], plain(row["value"])) == want
    if row["code"] is None and data is not None and not data.endswith(b"isomxy"):
        assert bytes(row["back"]) == data
    elif row["code"]:
        assert row["back"] is None


def test_headers_and_sums(spark):
    rows = [("0", "moov", None), (str(2**32 - 9), "mdat", None), (str(2**32 - 8), "mdat", None), (str(2**64 - 17), "mdat", None), ("5", "uuid", bytearray(range(16)))]
    df = spark.createDataFrame(rows, "n string, code string, uuid binary").withColumn("n", F.col("n").cast("decimal(20,0)"))
    got = [bytes(r[0]) for r in df.select(box_header(F.col("n"), F.col("code"), F.col("uuid"))).collect()]
    assert got == [b"\0\0\0\x08moov", b"\xff" * 4 + b"mdat", b"\0\0\0\1mdat" + (2**32 + 8).to_bytes(8), b"\0\0\0\1mdat" + b"\xff" * 8, (29).to_bytes(4) + b"uuid" + bytes(range(16))]
    sums = spark.createDataFrame([(5, -6), (5, -5), (2**32 - 1, 1), (2**32 - 2, 1)], "a long, b long").select(checked_add(F.col("a"), F.col("b"), 32)).collect()
    assert [r[0] and int(r[0]) for r in sums] == [None, 0, None, 2**32 - 1]


KIND = UUID("6f9619ff-8b86-d011-b42d-00cf4fc964ff")
POINT = (("x", "u16"), ("y", "i8"))
OWN = (("at", POINT), ("mode", "flags:03"), ("points", ("counted", (("p", POINT), ("pad", "zero:1")))))
GOOD = b"\0\1\xff" + b"\2" + (2).to_bytes(4) + b"\0\5\6\0" + b"\1\0\7\0"


@pytest.mark.parametrize("kind", [KIND, "mine", b"m\xffne", 0x6D6F6F76])
def test_own_boxes(spark, kind):
    code, uuid = S.box_type(kind)
    head = code.encode("latin-1"), uuid or b""
    whole = box(*head[:1], GOOD, uuid=head[1])
    cases = {
        "good": (whole, None),
        "wide": (box(head[0], GOOD, uuid=head[1], wide=True), None),
        "to the end": (box(head[0], GOOD, uuid=head[1], until_eof=True), None),
        "flag": (box(head[0], GOOD.replace(b"\xff\2", b"\xff\4"), uuid=head[1]), "InvalidInput"),
        "inner zero": (box(head[0], GOOD[:-1] + b"\1", uuid=head[1]), "InvalidInput"),
        "short array": (box(head[0], GOOD[:-1], uuid=head[1]), "TruncatedBox"),
        "other type": (box("else", GOOD), "InvalidInput"),
        "cut": (whole[:-1], "TruncatedBox"),
        "cut header": (whole[:7], "TruncatedBox"),
        "after": (whole + b"x", "InvalidInput"),
        "small": (box(head[0], GOOD, uuid=head[1], size=7), "InvalidInput"),
        "null": (None, "TruncatedBox"),
    }
    df = spark.createDataFrame([(n, d and bytearray(d)) for n, (d, _) in cases.items()], "name string, data binary").select("name", S.decode_box(F.col("data"), kind, OWN).alias("d"))
    for r in df.select("name", "d.code", "d.value", S.encode_box(F.col("d.value"), kind, OWN).alias("back")).collect():
        assert r["code"] == cases[r["name"]][1], r
        if r["code"] is None:
            assert r["value"].asDict(True) == {"at": {"x": 1, "y": -1}, "mode": 2, "points": [{"p": {"x": 5, "y": 6}}, {"p": {"x": 256, "y": 7}}]}
            assert bytes(r["back"]) == whole
        else:
            assert r["value"] is None and r["back"] is None


def test_own_box_types():
    with pytest.raises(ValueError):
        S.box_type("fives")
    with pytest.raises(ValueError):
        S.size_of((("inner", (("a", "rest:u32"),)),))


def test_decoded_once_however_often_used(spark):
    """Several parts of a decoded box are taken from one decoding, in which the payload is cut out once."""
    fields = (("brand", "fourcc"), ("items", ("counted", (("line", "u8"), ("part", "u32")))))
    d = spark.range(1).select(F.col("id").cast("string").cast("binary").alias("data")).select(S.decode_box(F.col("data"), "abcd", fields).alias("d"))
    text = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    whole, parts = text(d), text(d.select("d.code", "d.value.brand", F.size("d.value.items").alias("n"), F.col("d.value.items")[0]["part"].alias("first")))
    assert 0 < parts.count("conv(") <= whole.count("conv(")
    assert whole.count("conv(") < 25


def test_numbers_encode_in_their_bytes(spark):
    """Numbers of any sign and size that fit their fields; decimals take the same bytes as integers."""
    for kind, n, values in (("u8", 1, (0, 255)), ("i8", 1, (-1, -128, 127)), ("i16", 2, (-2, 300)), ("u24", 3, (2**24 - 1,)), ("u32", 4, (0, 2**32 - 1)), ("i32", 4, (-(2**31),)), ("u64", 8, (2**64 - 1, 2**63)), ("i64", 8, (-1, -(2**63)))):
        for big in (True, False):
            df = spark.createDataFrame([(str(v),) for v in values], "v string").select(F.col("v").cast("decimal(20,0)").alias("v"))
            got = [bytes(r[0]) for r in df.select(encode(F.struct("v"), (("v", kind),), big)).collect()]
            assert got == [(v % 2 ** (8 * n)).to_bytes(n, "big" if big else "little") for v in values]
