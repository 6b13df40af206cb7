"""Command line: spark-submit siftreel/cli.py [--format mp4|webp] [--output FOLDER] [--cumulative-mdat-box-size N] PATH"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siftreel.operators.dispatch import FORMATS, sanitize, sanitized
from siftreel.sources.files import read_files, write_files


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="siftreel", description="Check media files and write sanitised ones.")
    p.add_argument("--format", "-t", choices=FORMATS, help="the files' format; else their extensions say it")
    p.add_argument("--output", "-o", help="folder for sanitised files; - writes one file to standard output")
    p.add_argument("--cumulative-mdat-box-size", "-c", type=int)
    p.add_argument("path", help="a file, a folder or a glob; - for standard input (with --format)")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("siftreel").getOrCreate()
    piped = a.path == "-"
    if piped and not a.format:
        p.error("standard input needs --format")
    files = spark.createDataFrame([("-", bytearray(sys.stdin.buffer.read()))], "path string, content binary") if piped else read_files(spark, a.path)
    options = {"cumulative_mdat_box_size": a.cumulative_mdat_box_size}
    if a.format:
        files, options["format"] = files.withColumn("format", F.lit(a.format)), "format"
    counts = sanitize(files, **options).groupBy("format", "ok", "err.code", "err.arg").count().orderBy("format", "ok", "code", "arg").collect()
    for r in counts:
        print(r["format"], "ok" if r["ok"] else " ".join(filter(None, (r["code"], r["arg"]))), r["count"], sep="\t", file=sys.stderr if a.output == "-" else sys.stdout)
    if a.output == "-":
        for r in sanitized(files, **options).limit(1).collect():
            sys.stdout.buffer.write(r["content"])
            sys.stdout.buffer.flush()
    elif a.output:
        below = a.path if not piped and not any(c in a.path for c in "*?[{") and os.path.isdir(a.path.removeprefix("file://")) else None
        print(f"{write_files(sanitized(files, **options), a.output, root=below and os.path.abspath(below.removeprefix('file://')))} files written to {a.output}")
    return int(any(not r["ok"] for r in counts))


if __name__ == "__main__":
    sys.exit(main())
