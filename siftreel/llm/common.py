"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package (on a cluster: install it, or pass it with --py-files)."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset: the checkpoint folder set
    by code, or, if driver and executors are one process, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="siftreel-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get()
    return found


def table(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor costs nothing written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siftreel/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    back = spark.read.schema(df.schema).parquet(path)
    back._siftreel_path = path
    return back


def drop(df: DataFrame | None) -> None:
    """Remove a table() that nothing will read again."""
    path = getattr(df, "_siftreel_path", None)
    if path:
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    """Tasks for an explicit repartition by a key: what the session sets for shuffles."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_row(df: DataFrame, name: str) -> DataFrame:
    """All columns of df in one struct, so that no column of the input can clash with an operator's own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def trim() -> None:
    """Give memory that a Python worker has freed back to the system, since the next task's worker is the same process."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
