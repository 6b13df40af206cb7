"""A data source for MP4 files of any size: only box headers, ftyp and moov are read, by seeking.

spark.dataSource.register(LargeMp4); spark.read.format("large_mp4").load("/folder/*.mp4") gives mp4_walk's columns, for
mp4_verdict. Options: max_metadata_size, cumulative_mdat_box_size, every_box (true; false leaves out boxes that no verdict
needs, for files of millions of boxes). The files must lie on a file system that executors
mount.
"""

from __future__ import annotations

import glob
import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.mp4_walk import METADATA_LIMIT, WALK_SQL, moved, plain, walk


class LargeMp4(DataSource):
    @classmethod
    def name(cls) -> str:
        return "large_mp4"

    def schema(self) -> str:
        return f"path string, {WALK_SQL}"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.pattern = options["path"].removeprefix("file://").removeprefix("file:")
        self.limit = int(options.get("max_metadata_size", METADATA_LIMIT))
        size = options.get("cumulative_mdat_box_size")
        self.mdat_size = None if size is None else int(size)
        self.every = str(options.get("every_box", "true")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        found = sorted(p for p in glob.glob(os.path.join(self.pattern, "**") if os.path.isdir(self.pattern) else self.pattern, recursive=True) if os.path.isfile(p))
        return [InputPartition(p) for p in found]

    def read(self, partition: InputPartition):
        from pyspark.sql import Row

        with open(partition.value, "rb") as f:
            w = plain(moved(walk(f, os.fstat(f.fileno()).st_size, self.limit, self.mdat_size, self.every)))
        as_row = lambda x: Row(**{k: as_row(v) for k, v in x.items()}) if isinstance(x, dict) else [as_row(v) for v in x] if isinstance(x, list) else x
        yield (partition.value, *[as_row(w[c]) for c in ("length", "boxes", "cut", "ftyp", "moov", "moovs", "gap", "moved", "outside")])
