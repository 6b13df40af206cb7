from io import BytesIO

import numpy as np
import pyarrow as pa
import pytest
from media import box, co, ftyp, moov

from siftreel.operators import mp4_walk as mp4_walk_module
from siftreel.operators.mp4 import mp4_boxes, mp4_chunk_offsets, mp4_sanitize, mp4_track_stats, mp4_verdict, mp4_walk, mp4_zeroed
from siftreel.operators.mp4_walk import METADATA_LIMIT, moved, walk

F, M, D = ftyp(), moov(co([])), box("mdat", b"\xba\xdc\x0f\xfe\xbe\xef")
BIG = 2**64 - 1

#: name: (bytes, options, verdict): code, (code, arg), None for no change, or a dict of what must hold.
CASES = {
    "until_eof_sized_moov": (F + D + moov(co([]), until_eof=True), {}, {"displacement": len(M)}),
    "until_eof_sized_mdat": (F + M + box("mdat", b"123456", until_eof=True), {}, None),
    "skip": (F + box("mdat", b"1234567") + M, {}, {"span": (20, 15)}),
    "max_input_length": (F + M + box("mdat", b"", wide=True, size=BIG - len(F + M)), {}, None),
    "input_length_overflow": (F + M + box("mdat", b"", wide=True, size=BIG - len(F + M) + 1), {}, ("InvalidData", None)),
    "box_size_overflow": (F + M + box("mdat", b"", wide=True, size=BIG), {}, ("InvalidData", None)),
    "ftyp_too_large": (ftyp(brands=[b"isom"] * 255) + D + M, {}, "InvalidInput"),
    "ftyp_largest": (ftyp(brands=[b"isom"] * 254) + D + M, {}, {}),
    "max_moov_size": (F + D + M, {"max_metadata_size": len(M) - 8}, {}),
    "moov_too_large": (F + D + M, {"max_metadata_size": len(M) - 9}, "InvalidInput"),
    "mdat_after_moov": (F + M + D, {}, None),
    "no_ftyp": (M + D, {}, "InvalidBoxLayout"),
    "multiple_ftyp": (F + F + M + D, {}, "InvalidBoxLayout"),
    "ftyp_not_first_box": (box("free", b"12345") * 2 + F + D + M, {}, {"span": (46, 14)}),
    "ftyp_not_first_significant_box": (M + F + D, {}, "InvalidBoxLayout"),
    "no_moov": (F + D, {}, ("MissingRequiredBox", "moov")),
    "no_mdat": (F + M, {}, ("MissingRequiredBox", "mdat")),
    "free_boxes_in_metadata": (F + box("free", b"12345") + box("skip", b"12345") + D + M + box("free", b"12345"), {}, {"span": (46, 14)}),
    "free_boxes_after_mdat": (F + D + box("skip", b"12345") + box("free", b"12345") + M, {}, {"span": (20, 40)}),
    "meta_boxes_in_metadata": (F + D + M + box("meta") + box("meco"), {}, {"span": (20, 14)}),
    "meta_boxes_after_mdat": (F + D + box("meta") + D + box("meco") + M, {}, {"span": (20, 44)}),
    "multiple_mdat": (F + D + box("free", b"12345") + D + D + box("free", b"12345") + M, {}, {"span": (20, 68)}),
    "uuid": (F + M + box("uuid", b"", uuid=bytes(range(16))) + D, {}, ("UnsupportedBox", "00010203-0405-0607-0809-0a0b0c0d0e0f")),
    "mp41": (ftyp(b"mp41", [b"mp41"]) + D + M, {}, ("UnsupportedFormat", "mp41")),
    "mp42": (ftyp(brands=[b"mp42", b"isom"]) + D + M, {}, {}),
    "no_compatible_brands": (ftyp(brands=[]) + D + M, {}, ("UnsupportedFormat", "isom")),
    "no_trak": (F + D + moov(drop="trak"), {}, ("MissingRequiredBox", "trak")),
    "no_mdia": (F + D + moov(drop="mdia"), {}, ("MissingRequiredBox", "mdia")),
    "no_minf": (F + D + moov(drop="minf"), {}, ("MissingRequiredBox", "minf")),
    "no_stbl": (F + D + moov(drop="stbl"), {}, ("MissingRequiredBox", "stbl")),
    "no_stco": (F + D + moov(), {}, ("MissingRequiredBox", "co64")),
    "co64": (F + D + moov(co([28, 29], 8)), {}, {}),
    "stco_and_co64": (F + D + moov(co([]), co([], 8)), {}, "InvalidBoxLayout"),
    "cumulative_default": (F + box("mdat", b"123456" + M, until_eof=True), {}, ("MissingRequiredBox", "moov")),
    "cumulative_mdat_box_size": (F + box("mdat", b"123456", until_eof=True) + M, {"cumulative_mdat_box_size": 14}, {"span": (20, 14)}),
    "cumulative_too_small": (F + box("mdat", b"123456", until_eof=True) + M, {"cumulative_mdat_box_size": 7}, "InvalidInput"),
    # not among the reference's own tests: read off its rules
    "gap_0": (F + box("free", bytes(len(M) - 8)) + D + M, {}, {"displacement": 0, "pad_size": 0}),
    "gap_4": (F + box("free", bytes(len(M) - 4)) + D + M, {}, {"displacement": -4, "pad_size": 0}),
    "gap_8": (F + box("free", bytes(len(M))) + D + M, {}, {"displacement": 0, "pad_size": 8}),
    "gap_100": (F + box("free", bytes(len(M) + 92)) + D + M, {}, {"displacement": 0, "pad_size": 100}),
    "stco_underflow": (F + box("free", bytes(len(moov(co([1]))) - 4)) + D + moov(co([1])), {}, "InvalidInput"),
    "stco_overflow": (F + D + moov(co([2**32 - 1])), {}, "InvalidInput"),
    "co64_overflow": (F + D + moov(co([BIG], 8)), {}, "InvalidInput"),
    "mdat_moov_mdat": (F + D + M + D, {}, "UnsupportedBoxLayout"),
    "two_moov": (F + D + M + moov(co([5])), {}, {"displacement": len(M) + 4}),
    "truncated_last_mdat": (F + M + box("mdat", b"", size=1000), {}, None),
    "size_2": (F + box("mdat", b"", size=2), {}, "InvalidInput"),
    "partial_header": (F + D + M + b"\0\0\0", {}, "TruncatedBox"),
    "stco_version": (F + D + moov(co([], version=1 << 24)), {}, "InvalidInput"),
    "stco_cut": (F + D + moov(co([], count=1)), {}, "TruncatedBox"),
    "stco_long": (F + D + moov(co([1, 2], count=1)), {}, "InvalidInput"),
    "stco_count_overflow": (F + D + moov(co([], count=1 << 30)), {}, "InvalidInput"),
    "two_stco": (F + D + moov(co([]), co([])), {}, "InvalidBoxLayout"),
    "wide_ftyp": (ftyp(wide=True) + D + M, {}, {"span": (28, 14)}),
    "wide_stco": (F + D + moov(box("stco", bytes(8), wide=True)), {}, {}),
    "empty": (b"", {}, ("MissingRequiredBox", "ftyp")),
    "null": (None, {}, ("MissingRequiredBox", "ftyp")),
    "moov_cut": (F + D + M[:-1], {}, "TruncatedBox"),
    "ftyp_cut": (F[:-1], {}, "TruncatedBox"),
    "ftyp_short": (box("ftyp", b"isom") + D + M, {}, "TruncatedBox"),
    "ftyp_odd_tail": (ftyp(brands=[b"isom", b"xyz"]) + D + M, {}, {}),
    "unknown": (F + D + M + box("abc "), {}, ("UnsupportedBox", "abc")),
    "unknown_bytes": (F + D + M + box(b"\xff\xfe\xfd\xfc"), {}, ("UnsupportedBox", "0xfffefdfc")),
    "child_small": (F + D + box("moov", box("trak", size=4)), {}, "InvalidInput"),
    "child_long": (F + D + box("moov", box("trak", size=40)), {}, "TruncatedBox"),
    "two_traks": (F + D + moov(co([7]), traks=2), {}, {}),
}


@pytest.fixture(scope="module")
def verdicts(spark):
    out = {}
    for options in {tuple(sorted(o.items())) for _, o, _ in CASES.values()}:
        rows = [(n, bytearray(c) if c is not None else None, "x") for n, (c, o, _) in CASES.items() if tuple(sorted(o.items())) == options]
        out |= {r["path"]: r for r in mp4_sanitize(spark.createDataFrame(rows, "path string, content binary, span string"), **dict(options)).collect()}
    return out


@pytest.mark.parametrize("name", CASES)
def test_verdict(verdicts, name):
    content, _, want = CASES[name]
    got = verdicts[name]
    if isinstance(want, str | tuple):
        code, arg = want if isinstance(want, tuple) else (want, ...)
        assert not got["ok"] and got["err"]["code"] == code, got
        assert arg is ... or got["err"]["arg"] == arg
        assert got["metadata"] is None and got["span"] is None
    else:
        assert got["ok"] and got["err"] is None, got
        assert (got["metadata"] is None) == (want is None)
        for k, v in (want or {}).items():
            assert (tuple(map(int, got[k])) if k == "span" else got[k]) == v


def test_sanitised_again_and_offsets(spark, verdicts):
    """The new file is accepted, its metadata lies before the media, and offsets point to the same media bytes."""
    rows, media = [], {}
    for n, (content, _, _) in CASES.items():
        v = verdicts[n]
        if v["ok"] and v["metadata"] is not None:
            a, b = map(int, v["span"])
            media[n] = content[a : a + b]
            rows.append((n, bytearray(v["metadata"]) + media[n]))
    again = mp4_sanitize(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert len(again) == len(rows) > 20
    for r in again:
        assert r["ok"] and r["metadata"] is None, r
        assert int(r["span"]["offset"]) == len(verdicts[r["path"]]["metadata"]), r


def test_chunk_offsets(spark):
    m = moov(co([28, 30, 33]), traks=2)
    v = mp4_sanitize(spark.createDataFrame([("a", bytearray(F + D + m)), ("b", bytearray(F + D + moov(co([28, 30], 8))))], "path string, content binary"))
    got = sorted((r["path"], r["trak"], r["i"], int(r["chunk_offset"])) for r in mp4_chunk_offsets(v).collect())
    w = len(moov(co([28, 30], 8)))
    assert got == [("a", t, i, e + len(m)) for t in (0, 1) for i, e in enumerate([28, 30, 33])] + [("b", 0, i, e + w) for i, e in enumerate([28, 30])]


def test_boxes_stats_zeroed(spark):
    files = spark.createDataFrame([("a", bytearray(F + D + moov(co([1, 2]), traks=3))), ("e", bytearray())], "path string, content binary")
    w = mp4_walk(files)
    assert [(r["type"], int(r["pos"])) for r in mp4_boxes(w).orderBy("ord").collect()] == [("ftyp", 0), ("mdat", 20), ("moov", 34)]
    assert [tuple(r) for r in mp4_track_stats(w).collect()] == [("a", 3, 6)]
    z = {r["path"]: bytes(r["content"]) for r in mp4_zeroed(files).collect()}
    assert z == {"a": F + box("mdat", bytes(6)) + moov(co([1, 2]), traks=3), "e": b""}


def test_no_rows(spark):
    assert mp4_sanitize(spark.createDataFrame([], "path string, content binary")).collect() == []


def test_compare_media(spark):
    """What offsets point to is the same after rewriting; a wrong offset, a lost chunk and changed media are seen."""
    from media import box, co, ftyp, moov

    from siftreel.operators.dispatch import sanitized
    from siftreel.operators.verify import mp4_compare_media

    media = bytes(range(200))
    old = ftyp() + box("mdat", media) + moov(co([28, 60, 10_000]))
    new = bytes(sanitized(spark.createDataFrame([("a.mp4", bytearray(old))], "path string, content binary")).first()["content"])
    n = len(moov(co([28, 60, 10_000])))
    wrong = ftyp() + moov(co([28 + n, 61 + n, 10_000 + n])) + box("mdat", media)
    fewer = ftyp() + moov(co([24 + n, 56 + n])) + box("mdat", media)
    bent = new[:-150] + b"x" + new[-149:]
    rows = [("fine", old, new), ("wrong", old, wrong), ("fewer", old, fewer), ("bent", old, bent), ("none", old, b""), ("null", None, None), ("same", old, old)]
    df = spark.createDataFrame([(k, x and bytearray(x), y and bytearray(y)) for k, x, y in rows], "path string, before binary, after binary")
    got = {r["path"]: (r["chunks"], r["moved"], r["same"]) for r in mp4_compare_media(df).collect()}
    assert got == {"fine": (3, 3, True), "wrong": (3, 3, False), "fewer": (2, 2, False), "bent": (3, 3, False), "none": (None, None, None), "null": (None, None, None), "same": (3, 0, True)}


def test_error_details(verdicts):
    """Limits and sizes, and the boxes around a fault with their offsets in the file."""
    at = len(F) + len(D)
    stbl = [f"moov@{at}", f"trak@{at + 20}", f"mdia@{at + 39}", f"minf@{at + 47}", f"stbl@{at + 55}"]
    want = {
        "ftyp_too_large": ("payload of 1028 bytes, at most 1024 are read", ["ftyp@0"]),
        "moov_too_large": (f"payload of {len(M) - 8} bytes, at most {len(M) - 9} are read", [f"moov@{at}"]),
        "moov_cut": (f"payload of {len(M) - 8} bytes, {len(M) - 9} are there", [f"moov@{at}"]),
        "size_2": ("size 2 is less than the header's 8 bytes", ["mdat@20"]),
        "no_stco": ("no co64 box", stbl),
        "stco_cut": ("1 entries of 4 bytes, 0 bytes are there", [*stbl, f"stco@{at + 72}"]),
        "child_small": ("size 4 of trak is less than its header's 8 bytes", [f"moov@{at}"]),
        "null": ("the file has no ftyp box", None),
    }
    assert {n: (verdicts[n]["err"]["detail"], verdicts[n]["err"]["stack"]) for n in want} == want
    assert all(v["ok"] or v["err"]["detail"] for v in verdicts.values())


@pytest.mark.parametrize("name", CASES)
def test_left_out_boxes_change_nothing(name):
    """The walk that leaves out silent boxes keeps what decides: the first fault, first mdat, the ends of the span, the last moov."""
    content, options, _ = CASES[name]
    args = BytesIO(content or b""), len(content or b""), options.get("max_metadata_size", METADATA_LIMIT), options.get("cumulative_mdat_box_size")
    every, few = moved(walk(*args)), moved(walk(*args, every=False))
    listed = [b._replace(ord=0) for b in every["boxes"]]
    assert [b for b in listed if b in [x._replace(ord=0) for x in few["boxes"]]] == [b._replace(ord=0) for b in few["boxes"]]
    assert [b.ord for b in few["boxes"]] == list(range(len(few["boxes"])))


def test_verdicts_of_either_walk(spark, verdicts):
    """Verdicts over all boxes equal those over the boxes that matter."""
    for options in {tuple(sorted(o.items())) for _, o, _ in CASES.values()}:
        rows = [(n, bytearray(c) if c is not None else None) for n, (c, o, _) in CASES.items() if tuple(sorted(o.items())) == options]
        o = dict(options)
        for r in mp4_verdict(mp4_walk(spark.createDataFrame(rows, "path string, content binary"), **o), o.get("max_metadata_size", METADATA_LIMIT)).collect():
            assert r == verdicts[r["path"]]


def test_millions_of_boxes():
    """A long run of small boxes of any kind that may repeat stays short, and faults end the walk."""
    run = (box("free") + box("mdat") + box("meta") + box("skip")) * 20_000
    w = moved(walk(*(lambda c: (BytesIO(c), len(c)))(F + D + run + M * 1_000), every=False))
    assert len(w["boxes"]) == 4 and [b.type for b in w["boxes"]] == [b"ftyp", b"mdat", b"moov", b"moov"] and len(w["moovs"]) == 2
    bad = F + D + M + box("uuid", uuid=bytes(16)) * 1_000
    assert len(walk(BytesIO(bad), len(bad), every=False)["boxes"]) == 4


def test_many_offsets():
    """Offsets of both widths move in place, as plain integers do."""
    small, wide = [10**6 + k for k in range(50_000)], [2**40 + k for k in range(50_000)]
    c = F + D + box("moov", b"".join(box("trak", box("mdia", box("minf", box("stbl", t)))) for t in (co(small), co(wide, 8), co([]))))
    w = moved(walk(BytesIO(c), len(c)))
    size = len(w["moov"]) + 8
    assert (w["gap"], w["moved"], w["outside"]) == (-size, size, False)
    got = [np.frombuffer(w["moov"], f">u{t['width']}", t["n"], t["at"]).tolist() for t in w["moovs"][-1]["tables"]]
    assert got == [[e + size for e in x] for x in (small, wide, [])]


def _run(kernel, *contents):
    return [r for b in kernel(iter([pa.RecordBatch.from_pydict({"path": [str(k) for k in range(len(contents))], "content": list(contents)})])) for r in b.to_pylist()]


def test_zeroed_in_one_pass(monkeypatch):
    """Media is zeroed where the boxes are walked, without going into moov; boxes that are cut or too small stay as they are."""
    monkeypatch.setattr(mp4_walk_module, "tables", lambda *a: pytest.fail("moov was gone into"))
    cut, small = box("mdat", b"123456", size=50), box("mdat", b"", size=5)
    files = (F + D + M + b"\0\0\0", F + M + box("mdat", b"12", until_eof=True), F + cut, F + small, None)
    want = [F + box("mdat", bytes(6)) + M, F + M + box("mdat", bytes(2), until_eof=True), F + box("mdat", bytes(6), size=50), F + small, b""]
    assert [r["content"] for r in _run(mp4_walk_module.zero_kernel, *files)] == want


def test_only_the_columns_asked_for(monkeypatch):
    """A walk for some columns makes the same ones, and goes into moov only for those that need it."""
    files = [c for c, o, _ in CASES.values() if not o]
    everything = _run(mp4_walk_module.kernel(["path"], "content", METADATA_LIMIT, None), *files)
    for only in (["moovs"], ["length", "boxes"], ["ftyp"], ["cut", "moov"], ["gap", "outside"]):
        got = _run(mp4_walk_module.kernel(["path"], "content", METADATA_LIMIT, None, True, only), *files)
        assert got == [{c: r[c] for c in ("path", *only)} for r in everything]
    monkeypatch.setattr(mp4_walk_module, "tables", lambda *a: pytest.fail("moov was gone into"))
    assert len(_run(mp4_walk_module.kernel(["path"], "content", METADATA_LIMIT, None, True, ["ftyp"]), *files)) == len(files)


@pytest.mark.parametrize("width", (4, 8))
def test_few_offsets_move_as_many_do(width, monkeypatch):
    """One by one or as an array, also where some leave their field."""
    found = {}
    for most in (0, 64):
        monkeypatch.setattr(mp4_walk_module, "SMALL", most)
        for k, entries in enumerate(([5, 700], [2 ** (8 * width) - 3, 1], [2 ** (8 * width) - 1] * 64)):
            c = F + D + moov(co(entries, width))
            w = moved(walk(BytesIO(c), len(c)))
            assert found.setdefault(k, (bytes(w["moov"]), w["outside"])) == (bytes(w["moov"]), w["outside"])
    assert [x[1] for x in found.values()] == [False, True, True]
