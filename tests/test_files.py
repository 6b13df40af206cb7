import gzip
import io
import sys

import pytest
from media import VP8, VP8L, box, co, ftyp, moov, riff

from siftreel.operators.dispatch import format_of, sanitize, sanitized
from siftreel.operators.mp4 import mp4_verdict
from siftreel.sources.files import read_corpus, read_files, write_files
from siftreel.sources.large_mp4 import LargeMp4
from siftreel.streaming.files import stream_files, write_verdicts

MP4 = ftyp() + box("mdat", b"media") + moov(co([28]))
FILES = {"a.mp4": MP4, "b.MP4": ftyp() + moov(co([])) + box("mdat", b"x"), "c.webp": riff(VP8L), "d.webp": riff(VP8)[:-1], "e.txt": b"text", "f": b"-", "g.mp4": b""}


def folder(path, files=FILES):
    path.mkdir(parents=True, exist_ok=True)
    for name, data in files.items():
        (path / name).write_bytes(data)
    return str(path)


def name(path):
    return path.rsplit("/", 1)[-1]


def test_dispatch(spark, tmp_path):
    """Spark's scan leaves out the file of no bytes."""
    got = {name(r["path"]): (r["format"], r["ok"], r["err"] and r["err"]["code"]) for r in sanitize(read_files(spark, folder(tmp_path / "in"))).collect()}
    assert got == {"a.mp4": ("mp4", True, None), "b.MP4": ("mp4", True, None), "c.webp": ("webp", True, None), "d.webp": ("webp", True, None), "e.txt": (None, False, "UnknownFormat"), "f": (None, False, "UnknownFormat")}


def test_explicit_format(spark):
    df = spark.createDataFrame([("x", bytearray(MP4), "mp4"), ("y.mp4", bytearray(riff(VP8L)), "WEBP"), (None, None, None), ("z.mp4", None, "other")], "path string, content binary, kind string")
    got = {r["path"]: (r["format"], r["ok"], r["err"] and r["err"]["code"]) for r in sanitize(df, format="kind").collect()}
    assert got == {"x": ("mp4", True, None), "y.mp4": ("webp", True, None), None: (None, False, "UnknownFormat"), "z.mp4": ("other", False, "UnknownFormat")}
    paths = spark.createDataFrame([("a.Mp4",), ("/x.mp4/b",), (".mp4",), ("/d/.webp",), ("a.tar.webp",)], "p string")
    assert [r[0] for r in paths.select(format_of(paths["p"])).collect()] == ["mp4", None, None, None, "webp"]


def test_sink(spark, tmp_path):
    n = write_files(sanitized(read_files(spark, folder(tmp_path / "in"))), str(tmp_path / "out"))
    assert n == 4 and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.mp4", "b.MP4", "c.webp", "d.webp"]
    m = moov(co([28]))
    assert (tmp_path / "out/a.mp4").read_bytes() == ftyp() + moov(co([28 + len(m)])) + box("mdat", b"media")
    assert (tmp_path / "out/b.MP4").read_bytes() == FILES["b.MP4"]


def test_corpus(spark, tmp_path):
    folder(tmp_path / "valid", {"a.mp4": b"one", "b.mp4.gz": gzip.compress(b"two"), "c.txt": b"-"})
    folder(tmp_path / "invalid-fail", {"d.mp4.gz": b"not gzip"})
    got = sorted((r["kind"], name(r["path"]), r["content"] and bytes(r["content"])) for r in read_corpus(spark, str(tmp_path), "mp4").collect())
    assert got == [("invalid-fail", "d.mp4.gz", None), ("valid", "a.mp4", b"one"), ("valid", "b.mp4.gz", b"two")]
    assert read_corpus(spark, str(tmp_path / "none"), "mp4").collect() == []
    write_files(spark.createDataFrame([("x/z.mp4", bytearray(b"zero"))], "path string, content binary"), str(tmp_path / "gz"), compress=True)
    assert gzip.decompress((tmp_path / "gz/z.mp4.gz").read_bytes()) == b"zero"


def test_large_files(spark, tmp_path):
    """A sparse file of over 4 GiB is walked by its headers alone."""
    (tmp_path / "none.mp4").write_bytes(b"")
    big = tmp_path / "big.mp4"
    with big.open("wb") as f:
        f.write(ftyp() + box("mdat", wide=True, size=5 << 30))
        f.seek(20 + (5 << 30))
        f.write(moov(co([40], 8)))
    spark.dataSource.register(LargeMp4)
    v, none = mp4_verdict(spark.read.format("large_mp4").load(str(tmp_path))).orderBy("path").collect()
    assert none["err"]["code"] == "MissingRequiredBox"
    assert v["ok"] and (int(v["span"]["offset"]), int(v["span"]["len"])) == (20, 5 << 30) and v["displacement"] == len(moov(co([40], 8)))


def test_stream(spark, tmp_path):
    write = lambda: write_verdicts(stream_files(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    folder(tmp_path / "in", {"a.mp4": MP4})
    write()
    folder(tmp_path / "in", {"c.webp": riff(VP8L), "e.webp": b"RIFF"})
    write()
    got = {name(r["path"]): (r["ok"], r["err"] and r["err"]["code"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a.mp4": (True, None), "c.webp": (True, None), "e.webp": (False, "TruncatedChunk")}


def test_repeated_paths(spark):
    """Each accepted row comes out once, and nothing is shuffled."""
    df = spark.createDataFrame([("a.mp4", bytearray(MP4))] * 3 + [("c.webp", bytearray(riff(VP8L)))] * 2 + [("x.mp4", bytearray(b"-"))], "path string, content binary")
    out = sanitized(df)
    assert sorted(r["path"] for r in out.collect()) == ["a.mp4"] * 3 + ["c.webp"] * 2
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_sink_keeps_every_file(spark, tmp_path):
    """Files of one name stay apart below their root; without a root they are refused, and nothing is overwritten."""
    for k in "ab":
        folder(tmp_path / "in" / k, {"f.mp4": MP4 + box("free", k.encode())})
    files = read_files(spark, str(tmp_path / "in"))
    with pytest.raises(ValueError, match="f.mp4"):
        write_files(files, str(tmp_path / "flat"))
    assert list((tmp_path / "flat").iterdir()) == []
    assert write_files(files, f"file://{tmp_path}/out", root=str(tmp_path / "in")) == 2
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*.mp4")) == ["a/f.mp4", "b/f.mp4"]
    assert [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith(".")] == []


def test_long_padding(spark, tmp_path):
    """A free box of 3 GiB before the media gives a verdict; its zeros are only counted."""
    size = 3 << 30
    with (tmp_path / "pad.mp4").open("wb") as f:
        f.write(ftyp() + size.to_bytes(4, "big") + b"free")
        f.seek(20 + size)
        f.write(box("mdat", b"media") + moov(co([40])))
    spark.dataSource.register(LargeMp4)
    v = mp4_verdict(spark.read.format("large_mp4").load(str(tmp_path))).first()
    m = moov(co([40]))
    assert v["ok"] and v["displacement"] == 0 and v["pad_size"] == size - len(m)
    assert bytes(v["metadata"]) == ftyp() + m + (size - len(m)).to_bytes(4, "big") + b"free"
    small = ftyp() + box("free", bytes(2 << 20)) + box("mdat", b"media") + m
    out = bytes(sanitized(spark.createDataFrame([("a.mp4", bytearray(small))], "path string, content binary")).first()["content"])
    assert len(out) == len(small) - len(m) and out == ftyp() + m + (len(small) - 2 * len(m) - 20 - 13).to_bytes(4, "big") + b"free" + bytes(len(small) - 2 * len(m) - 20 - 13 - 8) + box("mdat", b"media")


def test_command_line(spark, tmp_path, monkeypatch, capsysbinary):
    from siftreel.cli import main

    assert main(["--output", str(tmp_path / "out"), folder(tmp_path / "in", {k: FILES[k] for k in ("a.mp4", "c.webp")})]) == 0
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.mp4", "c.webp"]
    assert main([str(tmp_path / "in/a.mp4"), "-t", "webp"]) == 1
    monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO(MP4)))
    capsysbinary.readouterr()
    m = moov(co([28]))
    monkeypatch.setattr("pyspark.sql.SparkSession.stop", lambda self: None)
    assert main(["-t", "mp4", "-o", "-", "-"]) == 0
    assert capsysbinary.readouterr().out == ftyp() + moov(co([28 + len(m)])) + box("mdat", b"media")


def test_files_of_all_formats_in_one_pass(spark):
    """One read of the files whatever their formats, with the verdicts that each sanitiser gives alone; others aren't read."""
    from siftreel.operators.mp4 import mp4_sanitize
    from siftreel.operators.webp import webp_sanitize

    good, bad = ftyp() + box("mdat", b"12") + moov(co([28])), ftyp(brands=(b"mp41",)) + moov(co([]))
    mp4 = [("a.mp4", bytearray(good)), ("b.MP4", bytearray(bad)), ("c.mp4", None)]
    webp = [("d.webp", bytearray(riff(VP8))), ("e.webp", bytearray(riff(VP8L, kind=b"WEBX"))), ("f.webp", None)]
    df = spark.createDataFrame([*mp4, *webp, ("g.png", bytearray(good)), ("h", None)], "path string, content binary")
    got = sanitize(df)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    rows = {r["path"]: r for r in got.collect()}
    assert len(rows) == 8
    for name, alone in (("mp4", mp4_sanitize(df.where("lower(path) like '%.mp4'"))), ("webp", webp_sanitize(df.where("path like '%.webp'")))):
        want = alone.collect()
        assert got.dtypes == alone.dtypes and len(want) == 3 and all(rows[r["path"]] == r and r["format"] == name for r in want)
    for path in ("g.png", "h"):
        assert rows[path].asDict(True) == {"path": path, "format": None, "ok": False, "err": {"kind": "Format", "code": "UnknownFormat", "arg": None, "detail": None, "stack": None}, "metadata": None, "span": None, "displacement": None, "pad_size": None}
