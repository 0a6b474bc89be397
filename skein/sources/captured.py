"""Captured answers as a data source: ``spark.read.format("captured").load(folder)``.

An archive is a folder of JSON-lines files, ``engine=<name>/page=<n>/<file>``,
each line with response_id and body, in any store that pyarrow opens
(``file:``, ``hdfs:``, ``s3:`` and so on). Each file is a partition. Filters on
engine and page are taken over: folders that cannot match are not even listed.
Spark hands filters on where ``spark.sql.python.filterPushdown.enabled`` is set.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "response_id bigint, engine string, page int, body string"
AT_ONCE = 1000


@dataclass
class File(InputPartition):
    path: str
    engine: str
    page: int


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.allowed: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes over equality and membership of engine and page; the others stay with Spark."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) else None
            if column not in ("engine", "page"):
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.allowed[column] = self.allowed.get(column, values) & values

    def _takes(self, column: str, value: object) -> bool:
        return column not in self.allowed or value in self.allowed[column]

    def partitions(self) -> list[InputPartition]:
        fs, root = pa.fs.FileSystem.from_uri(self.path) if "://" in self.path else (pa.fs.LocalFileSystem(), self.path)
        listed = lambda at: fs.get_file_info(pa.fs.FileSelector(at, allow_not_found=True))
        found = []
        for e in listed(root):
            engine = e.base_name.removeprefix("engine=")
            if e.type != pa.fs.FileType.Directory or not self._takes("engine", engine):
                continue
            for p in listed(e.path):
                page = p.base_name.removeprefix("page=")
                if page.isdigit() and self._takes("page", int(page)):
                    found += [File(f.path, engine, int(page)) for f in listed(p.path) if f.is_file]
        return found

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file matches
            return
        fs = pa.fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else pa.fs.LocalFileSystem()
        rows: list[dict] = []

        def batch() -> pa.RecordBatch:
            n = len(rows)
            arrays = [pa.array([r.get("response_id") for r in rows], pa.int64()), pa.array([partition.engine] * n, pa.string()), pa.array([partition.page] * n, pa.int32()), pa.array([r.get("body") for r in rows], pa.string())]
            return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in SCHEMA.split(", ")])

        with fs.open_input_stream(partition.path) as stream:
            for line in io.TextIOWrapper(stream, encoding="utf-8"):
                if line.strip():
                    rows.append(json.loads(line))
                if len(rows) == AT_ONCE:
                    yield batch()
                    rows.clear()
        if rows:
            yield batch()


class Captured(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captured"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Captured)
