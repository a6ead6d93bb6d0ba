"""A data source that replays landed answers of an HTTP interface, page after page, where
a live fetch would stand: spark.read.format('replay').option('path', folder).load()."""

from __future__ import annotations

import os

import pyarrow.fs as fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class ReplaySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> str:
        return "page string, position int, body string"

    def reader(self, schema) -> DataSourceReader:
        return ReplayReader(self.options["path"])


class ReplayReader(DataSourceReader):
    """A partition for each landed page, read from any store that Arrow can reach (a path or
    a URI); the folder must be one that all executors see."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        store, place = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(place))
        return [InputPartition(x.path) for x in sorted(found, key=lambda x: x.path) if x.is_file]

    def read(self, partition: InputPartition):
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_stream(partition.value) as f:
            for i, line in enumerate(x for x in f.read().decode().split("\n") if x.strip()):
                yield os.path.basename(partition.value), i, line
