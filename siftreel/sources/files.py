"""Tables of files: binaryFile scans, test corpora with gzipped members, and sinks."""

from __future__ import annotations

import gzip
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.session import ship

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def read_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length, content), a row for each file; content is read only if it is used.

    Spark's scan leaves out files of no bytes (the large_mp4 source has them) and fails on files over 2 GiB.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def read_corpus(spark: SparkSession, root: str, extension: str, dirs: tuple[str, ...] = ("valid", "invalid-pass", "invalid-fail")) -> DataFrame:
    """(kind, path, content) of *.extension and *.extension.gz below root's folders; gzipped members are unpacked.

    Folders that aren't there count as empty. A member that isn't gzip has a null content.
    """
    ship(spark)
    jvm = spark.sparkContext._jvm
    parts = []
    for kind in dirs:
        p = jvm.org.apache.hadoop.fs.Path(f"{root}/{kind}")
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            parts.append(read_files(spark, f"{root}/{kind}", f"*.{{{extension},{extension}.gz}}").select(F.lit(kind).alias("kind"), "path", "content"))
    if not parts:
        return spark.createDataFrame([], "kind string, path string, content binary")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)

    def unpack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for k in range(b.num_rows):
                name, data = b["path"][k].as_py(), b["content"][k].as_py()
                if name.endswith(".gz"):
                    try:
                        data = gzip.decompress(data)
                    except (OSError, EOFError):
                        data = None
                one = b.slice(k, 1)
                yield pa.RecordBatch.from_arrays([one["kind"], one["path"], pa.array([data], pa.binary())], ["kind", "path", "content"])

    return out.mapInArrow(unpack, "kind string, path string, content binary")


def write_files(files: DataFrame, folder: str, path: str = "path", content: str = "content", compress: bool = False, root: str | None = None) -> int:
    """Write each row's content to folder, under its path's last part, or its path below root; returns how many.

    folder: a path or URI that Arrow's file systems know and all executors reach. Files are first written under names of
    their own, so a task that runs again or is lost leaves no half files. If two rows have one name, nothing is renamed
    and a ValueError names it. Null paths are left out, null contents are empty. compress: gzip, with .gz added.
    """
    spark = files.sparkSession
    ship(spark)
    uri = folder if "://" in folder else os.path.abspath(folder.removeprefix("file:"))
    hidden = f"{uri.rstrip('/')}/.part-{uuid.uuid4().hex}"
    plain = lambda p: p.removeprefix("file://").removeprefix("file:")
    top = plain(root).rstrip("/") + "/" if root else None

    def opened():
        from pyarrow import fs

        return fs.FileSystem.from_uri(uri)

    def named(p: str) -> str:
        if top and plain(p).startswith(top):
            return plain(p)[len(top) :].strip("/")
        return p.rstrip("/").rsplit("/", 1)[-1]

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened()
        system.create_dir(f"{base}/{hidden.rsplit('/', 1)[-1]}", recursive=True)
        for b in it:
            names, parts = [], []
            for k in range(b.num_rows):
                names.append(named(b["path"][k].as_py()) + (".gz" if compress else ""))
                parts.append(f"{hidden.rsplit('/', 1)[-1]}/{uuid.uuid4().hex}")
                data = b["content"][k].as_py() or b""
                with system.open_output_stream(f"{base}/{parts[-1]}", compression=None) as f:
                    f.write(gzip.compress(data, mtime=0) if compress else data)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(parts)], ["name", "part"])

    def rename(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened()
        for b in it:
            for name, part in zip(b["name"].to_pylist(), b["part"].to_pylist(), strict=True):
                system.create_dir(f"{base}/{name}".rsplit("/", 1)[0], recursive=True)
                if system.get_file_info(f"{base}/{part}").is_file:  # else an earlier try of this task has done it
                    system.move(f"{base}/{part}", f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    rows = files.select(F.col(f"`{path}`").cast("string").alias("path"), F.col(f"`{content}`").alias("content")).where("path is not null")
    listed = f"{hidden}/list"
    rows.mapInArrow(write, "name string, part string").write.parquet(listed if "://" in listed else f"file://{listed}")
    done = spark.read.schema("name string, part string").parquet(listed if "://" in listed else f"file://{listed}")
    twice = done.groupBy("name").count().where("count > 1").select("name").first()
    try:
        if twice:
            raise ValueError(f"two files would be written as {twice[0]}")
        return done.mapInArrow(rename, "n long").agg(F.sum("n")).first()[0] or 0
    finally:
        system, base = opened()
        system.delete_dir(f"{base}/{hidden.rsplit('/', 1)[-1]}")
