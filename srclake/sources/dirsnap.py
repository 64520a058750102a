"""A directory tree as a DataFrame: every regular file with its bytes, also empty files and those starting with '_' or '.'.

spark.dataSource.register(DirectorySource); spark.read.format("dirsnap").option("include_hidden", "true").load(path)
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass
class Batch(InputPartition):
    """Files of one partition: some hundred, or some MB."""

    paths: tuple[str, ...]


class DirectorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dirsnap"

    def schema(self) -> str:
        return "path string, size long, content binary, error string"

    def reader(self, schema) -> DirectoryReader:
        return DirectoryReader(self.options)


class DirectoryReader(DataSourceReader):
    """The walk is on the driver and gives names and sizes alone; bytes are read where the partition runs, so the path must be
    one that all executors see."""

    FILES, BYTES = 512, 64 * 1024 * 1024

    def __init__(self, options):
        self.root = os.path.abspath(options["path"])
        self.hidden = str(options.get("include_hidden", "false")).lower() == "true"

    def partitions(self) -> list[Batch]:
        out, held, n = [], [], 0
        for path, size in self._walk():
            if held and (len(held) >= self.FILES or n + size > self.BYTES):
                out.append(Batch(tuple(held)))
                held, n = [], 0
            held.append(path)
            n += size
        return [*out, Batch(tuple(held))]

    def _walk(self) -> Iterator[tuple[str, int]]:
        for folder, folders, names in os.walk(self.root):
            folders[:] = sorted(d for d in folders if self.hidden or not d.startswith("."))
            for name in sorted(names):
                full = os.path.join(folder, name)
                if (self.hidden or not name.startswith(".")) and os.path.isfile(full):
                    yield os.path.relpath(full, self.root), os.path.getsize(full)

    def read(self, partition: Batch) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                with open(os.path.join(self.root, path), "rb") as f:
                    data = f.read()
                yield path.replace(os.sep, "/"), len(data), data, None
            except OSError as e:
                yield path.replace(os.sep, "/"), None, None, str(e)
