"""Line deduplication by site-relative frequency, with DataFrame functions only.

A line is boilerplate of its host if the share of the host's pages that contain it exceeds a ratio, and more than one
page has it: on a host with a lone page every line has a share of 1, and nothing would be left. Pages are counted through 128-bit hashes of trimmed lines, combined before the shuffle. What is found
is small by construction: a host has at most (mean distinct lines per page) / ratio such lines. It is broadcast after
its size is checked; a larger table is joined with salted hosts, so that a hot host is dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_row, drop, table

#: A line goes if more than this share of its host's pages has it (one in twelve or so: what a page says itself is said on few
#: others), and at least MIN_PAGES of them, the least number that is a repetition.
MAX_RATIO, MIN_PAGES = 0.08, 2
#: Boilerplate lines that may be broadcast (16 bytes each), and the salts for hosts beyond that.
BROADCAST_LINES, SALTS = 200_000, 64


def _hash(line: Column) -> Column:
    x = F.trim(line)
    return F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"))


def boilerplate(docs: DataFrame, text: str = "text", host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, h, g): hashes of the lines to drop. Blank lines and rows with a null host or text count for nothing."""
    known = docs.select(F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text")).where("host is not null and text is not null")
    mark = F.struct(F.lit(None).cast("long").alias("h"), F.lit(None).cast("long").alias("g"))  # counts the page itself
    lines = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), _hash))
    each = known.select("host", F.explode(F.concat(F.array(mark), lines)).alias("x")).select("host", "x.h", "x.g")
    counts = each.groupBy("host", "h", "g").agg(F.count("*").alias("n"))
    counts = table(counts.where(F.col("h").isNull() | (F.col("n") >= min_pages)), "line-counts")
    salt = F.array(*[F.lit(i) for i in range(SALTS)])
    pages = counts.where("h is null").select("host", F.col("n").alias("pages"), F.explode(salt).alias("salt"))
    often = counts.where("h is not null").withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int"))
    return often.join(pages, ["host", "salt"]).where(F.col("n") > F.col("pages") * max_ratio).select("host", "h", "g")


def line_dedup(
    docs: DataFrame, text: str = "text", host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, broadcast_lines: int = BROADCAST_LINES
) -> DataFrame:
    """docs with boilerplate lines taken out of text; adds n_lines and n_dropped.

    Lines are what \\n separates, compared without blanks at their ends; blank lines stay. A null host belongs to no
    site, its rows stay as they are; a null text stays null with 0 lines; a text that loses every line becomes empty.
    Repeated rows are pages of their own. Columns of docs named n_lines or n_dropped are replaced.
    """
    bad = boilerplate(docs, text, host, max_ratio, min_pages).groupBy("host").agg(F.collect_set(F.struct("h", "g")).alias("bad"))
    bad = table(bad, "boilerplate")
    size = bad.agg(F.sum(F.size("bad"))).first()[0] or 0
    rows = as_row(docs, "row").withColumn("host", F.col(f"row.`{host}`"))
    if size <= broadcast_lines:
        rows = rows.join(F.broadcast(bad), "host", "left")
    else:
        salt = F.array(*[F.lit(i) for i in range(SALTS)])
        rows = rows.withColumn("salt", F.pmod(F.xxhash64(f"row.`{text}`"), F.lit(SALTS)).cast("int"))
        rows = rows.join(bad.withColumn("salt", F.explode(salt)), ["host", "salt"], "left")
    old = F.split(F.col(f"row.`{text}`"), "\n")
    new = F.filter(old, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("bad"), _hash(x)))
    rows = rows.withColumn("kept", F.when(F.col("bad").isNull(), old).otherwise(new)).withColumn("old", old)
    added = {"n_lines": F.coalesce(F.size("old"), F.lit(0)), "n_dropped": F.coalesce(F.size("old") - F.size("kept"), F.lit(0))}
    own = [(F.array_join("kept", "\n").alias(text) if c == text else F.col(f"row.`{c}`")) for c in docs.columns if c not in added]
    return rows.select(*own, *[F.when(F.col("old").isNull(), F.lit(0)).otherwise(v).cast("long").alias(k) for k, v in added.items()])
