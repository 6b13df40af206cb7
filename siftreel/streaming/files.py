"""Verdicts over a stream of arriving files: the batch operators, unchanged, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.dispatch import sanitize
from ..sources.files import SCHEMA


def stream_files(spark: SparkSession, path: str, files_per_trigger: int = 1_000) -> DataFrame:
    """A streaming (path, modificationTime, length, content) of files that appear below path."""
    return spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(path)


def write_verdicts(files: DataFrame, out: str, checkpoint: str, available_now: bool = True, **options) -> StreamingQuery:
    """Append the verdicts of a stream of files to Parquet; every file is judged once."""
    writer = sanitize(files, **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
