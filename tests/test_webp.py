import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from media import ALPH, ALPH_FLAG, ANIM, ANIM_FLAG, EXIF_FLAG, ICCP_FLAG, VP8, VP8L, XMP_FLAG, anmf, bits, chunk, riff, vp8l, vp8x

from siftreel.operators.vp8l import Code, Fault
from siftreel.operators.webp import vp8l_header, webp_chunks, webp_sanitize
from siftreel.operators.webp_walk import verdict

ICCP, EXIF, XMP, TEST = chunk("ICCP", b"dummy ICCP profile"), chunk("EXIF", b"dummy EXIF data"), chunk("XMP ", b"dummy XMP data"), chunk("TeSt", b"abc")
LAYOUT, INPUT, CUT = "InvalidChunkLayout", "InvalidInput", "TruncatedChunk"
missing = lambda name: ("MissingRequiredChunk", name)
AA = ALPH_FLAG | ANIM_FLAG


def image(*fields, w=1, h=1):
    return riff(chunk("VP8L", vp8l(bits(*fields), w, h)))


ONE = ((1, 1), (0, 1), (0, 1), (0, 1))  # a prefix code of one symbol, 0
FIVE = ONE * 5


def one(symbol):
    return ((1, 1), (0, 1), (1, 1), (symbol, 8))


CASES = {
    "not_riff": (riff(VP8L, name=b"TeSt"), LAYOUT),
    "not_webp": (riff(VP8L, kind=b"TeSt"), INPUT),
    "file_len_zero": (riff(VP8L, size=0), CUT),
    "file_len_one": (riff(VP8L, size=1), CUT),
    "file_len_invalid": (riff(VP8L, size=2**32 - 9), INPUT),
    "file_extra_data": (riff(VP8L, after=bytes(8)), INPUT),
    "image_data_missing": (riff(), LAYOUT),
    "lossy": (riff(VP8), None),
    "lossless": (riff(VP8L), None),
    "vp8x_lossy": (riff(vp8x(), VP8), None),
    "vp8x_lossy_alpha_lossless": (riff(vp8x(ALPH_FLAG), ALPH, VP8), None),
    "vp8x_lossy_alpha_uncompressed": (riff(vp8x(ALPH_FLAG), chunk("ALPH", b"\0xx"), VP8), None),
    "vp8x_lossless": (riff(vp8x(), VP8L), None),
    "vp8x_lossless_alpha": (riff(vp8x(ALPH_FLAG), ALPH, VP8L), LAYOUT),
    "vp8x_animated": (riff(vp8x(ANIM_FLAG), ANIM, anmf(VP8L), anmf(VP8L)), None),
    "vp8x_animated_empty": (riff(vp8x(ANIM_FLAG), ANIM), missing("ANMF")),
    "vp8x_animated_lossy_lossless": (riff(vp8x(ANIM_FLAG), ANIM, anmf(VP8), anmf(VP8L)), None),
    "vp8x_animated_lossless_alpha": (riff(vp8x(AA), ANIM, anmf(ALPH, VP8L)), LAYOUT),
    "vp8x_animated_lossy_alpha": (riff(vp8x(AA), ANIM, anmf(ALPH, VP8)), None),
    "vp8x_animated_alpha_no_alpha": (riff(vp8x(AA), ANIM, anmf(ALPH, VP8), anmf(VP8L)), None),
    "vp8x_animated_no_alpha_alpha": (riff(vp8x(AA), ANIM, anmf(VP8L), anmf(ALPH, VP8)), None),
    "vp8x_animated_alph_missing": (riff(vp8x(AA), ANIM, anmf(VP8L)), None),
    "vp8x_animated_alph_wrong_order": (riff(vp8x(AA), ANIM, anmf(VP8L, ALPH)), LAYOUT),
    "vp8x_animated_unexpected_alph": (riff(vp8x(ANIM_FLAG), ANIM, anmf(ALPH, VP8L)), LAYOUT),
    "vp8x_image_data_missing": (riff(vp8x()), missing("VP8")),
    "vp8x_unexpected_alph": (riff(vp8x(), ALPH, VP8L), LAYOUT),
    "vp8x_unexpected_anim": (riff(vp8x(), ANIM, anmf(VP8L)), LAYOUT),
    "vp8x_unexpected_anmf": (riff(vp8x(), anmf(VP8L)), LAYOUT),
    "vp8x_alph_missing": (riff(vp8x(ALPH_FLAG), VP8L), LAYOUT),
    "vp8x_anim_missing": (riff(vp8x(ANIM_FLAG), anmf(VP8L)), LAYOUT),
    "vp8x_anim_anmf_missing": (riff(vp8x(ANIM_FLAG)), missing("ANIM")),
    "vp8x_iccp": (riff(vp8x(ICCP_FLAG), ICCP, VP8L), None),
    "vp8x_exif": (riff(vp8x(EXIF_FLAG), VP8L, EXIF), None),
    "vp8x_xmp": (riff(vp8x(XMP_FLAG), VP8L, XMP), None),
    "vp8x_all_meta": (riff(vp8x(ICCP_FLAG | EXIF_FLAG | XMP_FLAG), ICCP, VP8L, EXIF, XMP), None),
    "vp8x_wrong_order": (riff(VP8L, vp8x()), LAYOUT),
    "vp8x_alph_wrong_order": (riff(vp8x(ALPH_FLAG), VP8, ALPH), LAYOUT),
    "vp8x_iccp_wrong_order": (riff(vp8x(ICCP_FLAG), VP8L, ICCP), LAYOUT),
    "vp8x_exif_wrong_order": (riff(vp8x(EXIF_FLAG | XMP_FLAG), VP8L, XMP, EXIF), LAYOUT),
    "vp8x_xmp_wrong_order": (riff(vp8x(XMP_FLAG), XMP, VP8L), LAYOUT),
    "vp8x_iccp_missing": (riff(vp8x(ICCP_FLAG), VP8L), LAYOUT),
    "vp8x_exif_missing": (riff(vp8x(EXIF_FLAG), VP8L), missing("EXIF")),
    "vp8x_xmp_missing": (riff(vp8x(XMP_FLAG), VP8L), missing("XMP")),
    "vp8x_iccp_unexpected": (riff(vp8x(), ICCP, VP8L), LAYOUT),
    "vp8x_exif_unexpected": (riff(vp8x(), VP8L, EXIF), LAYOUT),
    "vp8x_xmp_unexpected": (riff(vp8x(), VP8L, XMP), LAYOUT),
    "lossless_max_image_data": (riff(chunk("VP8L", bytes.fromhex("2FFFFFFF0F818888184444C4FF454404212222222202"))), None),
    # read off the rules
    "unknown_chunk": (riff(VP8L, TEST), ("UnsupportedChunk", "TeSt")),
    "unknown_in_frame": (riff(vp8x(ANIM_FLAG), ANIM, anmf(VP8L, TEST)), ("UnsupportedChunk", "TeSt")),
    "pad_not_zero": (riff(chunk("VP8 ", b"abc", pad=b"x")), INPUT),
    "pad_absent": (riff(chunk("VP8 ", b"abc", pad=b"")), CUT),
    "header_cut": (riff(VP8L, b"TeSt"), CUT),
    "vp8x_reserved_bit": (riff(vp8x(1), VP8L), INPUT),
    "vp8x_reserved_byte": (riff(vp8x(0, reserved=b"\0\1\0"), VP8L), INPUT),
    "canvas_overflow": (riff(vp8x(0, 1 << 24, 1 << 24), VP8), INPUT),
    "vp8x_long": (riff(chunk("VP8X", bytes(12)), VP8L), INPUT),
    "vp8x_short": (riff(chunk("VP8X", bytes(8)), VP8L), CUT),
    "vp8l_version": (riff(chunk("VP8L", vp8l(version=1))), ("UnsupportedVp8lVersion", "1")),
    "vp8l_signature": (riff(chunk("VP8L", vp8l(signature=1))), INPUT),
    "vp8l_short": (riff(chunk("VP8L", vp8l()[:4])), CUT),
    "vp8l_not_canvas": (riff(vp8x(0, 2, 1), VP8L), INPUT),
    "frame_not_canvas": (riff(vp8x(ANIM_FLAG, 2, 2), ANIM, anmf(VP8L)), INPUT),
    "frame_empty": (riff(vp8x(ANIM_FLAG), ANIM, anmf()), LAYOUT),
    "anmf_flags": (riff(vp8x(ANIM_FLAG), ANIM, anmf(VP8L, flags=4)), INPUT),
    "alph_flags": (riff(vp8x(ALPH_FLAG), chunk("ALPH", b"\x02xx"), VP8), INPUT),
    "skip_past_eof": (riff(chunk("VP8 ", b"", size=100), size=112), None),
    "riff_too_long": (riff(VP8, size=200), INPUT),
    "anmf_beyond_riff": (riff(vp8x(ANIM_FLAG), ANIM, chunk("ANMF", bytes(16) + VP8L, size=200)), INPUT),
    "empty": (b"", missing("RIFF")),
    "null": (None, missing("RIFF")),
    "predictor_13": (image((1, 1), (0, 2), (0, 3), (0, 1), *one(13), *ONE * 4, (0, 3), *FIVE), None),
    "predictor_14": (image((1, 1), (0, 2), (0, 3), (0, 1), *one(14), *ONE * 4, (0, 3), *FIVE), INPUT),
    "cache_order_0": (image((0, 1), (1, 1), (0, 4)), INPUT),
    "cache_order_12": (image((0, 1), (1, 1), (12, 4)), INPUT),
    "cache_order_11": (image((0, 1), (1, 1), (11, 4), (0, 1), *FIVE), None),
    "transform_twice": (image((1, 1), (2, 2), (1, 1), (2, 2), (0, 3), *FIVE), INPUT),
    "transforms": (image((1, 1), (2, 2), (1, 1), (3, 2), (1, 8), (0, 1), *FIVE, (0, 3), *FIVE), None),
    "bits_cut": (image((0, 3), *ONE * 3), CUT),
    "code_empty": (image((0, 3), (0, 1), (0, 4), *[(0, 3)] * 4), "InvalidVp8lPrefixCode"),
    "code_incomplete": (image((0, 3), (0, 1), (0, 4), (2, 3), *[(0, 3)] * 3), "InvalidVp8lPrefixCode"),
    "too_many_symbols": (image((0, 3), (0, 1), (0, 4), (0, 3), (0, 3), (1, 3), (1, 3), (1, 1), (7, 3), (65535, 16)), INPUT),
    "repeat_overrun": (image((0, 3), *ONE * 4, (0, 1), (0, 4), (1, 3), (1, 3), (0, 3), (0, 3), (0, 1), *[(1, 1), (127, 7)] * 6), "InvalidVp8lPrefixCode"),
    "back_reference_first": (image((1, 1), (0, 2), (0, 3), (0, 1), (0, 1), (0, 4), (0, 3), (1, 3), (1, 3), (0, 3), (0, 1), *[(1, 1), (127, 7)], w=9, h=9), CUT),
}
UNKNOWN = {"unknown_chunk": None, "unknown_in_frame": None}


@pytest.fixture(scope="module")
def verdicts(spark):
    df = spark.createDataFrame([(n, bytearray(c) if c is not None else None) for n, (c, _) in CASES.items()], "path string, content binary")
    return [{r["path"]: r for r in webp_sanitize(df, allow_unknown_chunks=u).collect()} for u in (False, True)]


@pytest.mark.parametrize("name", CASES)
def test_verdict(verdicts, name):
    for got, want in ((verdicts[0][name], CASES[name][1]), (verdicts[1][name], UNKNOWN.get(name, CASES[name][1]))):
        code, arg = want if isinstance(want, tuple) else (want, ...)
        assert (got["err"] and got["err"]["code"]) == code, got
        assert got["ok"] == (want is None)
        assert arg is ... or got["err"]["arg"] == arg


def test_chunks_and_header(spark):
    data = riff(vp8x(ANIM_FLAG), ANIM, anmf(VP8L))
    df = spark.createDataFrame([("a", bytearray(data))], "path string, content binary")
    assert [(r["depth"], r["name"], r["len"]) for r in webp_chunks(df).orderBy("ord").collect()] == [(0, "RIFF", len(data) - 8), (1, "VP8X", 10), (1, "ANIM", 6), (1, "ANMF", 32), (2, "VP8L", 8)]
    df = spark.createDataFrame([(bytearray(vp8l(w=16384, h=300, version=5)),)], "data binary")
    assert tuple(df.select(vp8l_header(df["data"])).first()[0]) == (0x2F, 16384, 300, False, 5)


def test_no_rows(spark):
    none = spark.createDataFrame([], "path string, content binary")
    assert webp_sanitize(none).collect() == [] == webp_chunks(none).collect()


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([c for c, _ in CASES.values() if c]), st.data())
def test_any_bytes(data, draw):
    """No input makes the check break off; it says a code or nothing."""
    raw = bytearray(data)
    for _ in range(draw.draw(st.integers(0, 4))):
        raw[draw.draw(st.integers(0, len(raw) - 1))] = draw.draw(st.integers(0, 255))
    raw = bytes(raw[: draw.draw(st.integers(0, len(raw)))])
    code, _ = verdict(raw)
    assert code is None or code in {"InvalidChunkLayout", "InvalidInput", "InvalidVp8lPrefixCode", "MissingRequiredChunk", "TruncatedChunk", "UnsupportedChunk", "UnsupportedVp8lVersion"}


def test_prefix_codes():
    c = Code({0: 1, 1: 2, 2: 3, 3: 3})
    assert c.longest == 3 and sorted(set(c.table)) == [(0, 1), (1, 2), (2, 3), (3, 3)]
    for bad in ({}, {0: 2}, {0: 1, 1: 1, 2: 1}):
        with pytest.raises(Fault):
            Code(bad)


def test_error_details(verdicts):
    """Every fault says what was found; the stack names chunks by offset, the outermost first."""
    assert all(v["ok"] or v["err"]["detail"] for v in verdicts[0].values())
    got = verdicts[0]["anmf_beyond_riff"]["err"]
    assert got["stack"][0] == "RIFF@0" and got["stack"][1].startswith("ANMF@")
    assert verdicts[0]["predictor_14"]["err"]["detail"] == "predictor 14, at most 13 are allowed"


def test_chunks_of_many_files_go_out_together(spark, monkeypatch):
    """One batch for many files, not one for each; ords start again with each file."""
    files = spark.createDataFrame([(str(k), bytearray(riff(VP8L))) for k in range(300)] + [("none", None)], "path string, content binary").coalesce(1)
    assert sorted((r["path"], r["ord"], r["name"]) for r in webp_chunks(files).collect()) == sorted((str(k), *x) for k in range(300) for x in ((0, "RIFF"), (1, "VP8L")))
    seen = []
    monkeypatch.setattr(type(files), "mapInArrow", lambda self, run, schema: seen.append(run) or self)
    webp_chunks(files)
    got = [b.num_rows for b in seen[0](iter([pa.RecordBatch.from_pydict({"path": ["a", "b", "c", None], "content": [riff(VP8L)] * 2 + [None, riff(VP8)]})]))]
    assert got == [6]
