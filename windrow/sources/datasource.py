"""``spark.read.format("windrow")``: tables by their path, with windows pruned by the filters of plain SQL.

Register with ``spark.dataSource.register(WindrowDataSource)`` and set ``spark.sql.python.filterPushdown.enabled``.
Python workers read the files here, so PartitionedTable.scan, which uses Spark's own reader, is the faster way; this
one is for queries that only have SQL. All filters are given back, so Spark applies them to the rows again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import datasource as D
from pyspark.sql import types as T

from ..errors import TableError
from ..plans.bounds import Bounds, from_comparison
from .manifest import Manifest

#: The filters that bound windows, and their operators.
COMPARISONS = {D.EqualTo: "=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}


def open_folder(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def read_manifest(path: str) -> Manifest:
    fs, root = open_folder(path)
    found = fs.get_file_info(pa.fs.FileSelector(f"{root}/manifest", allow_not_found=True))
    versions = [int(m[1]) for f in found if (m := re.fullmatch(r"v(\d+)\.json", f.base_name))]
    if not versions:
        raise TableError(f"no partitioned table at {path}")
    with fs.open_input_stream(f"{root}/manifest/v{max(versions)}.json") as stream:
        return Manifest.parse(stream.readall().decode())


class WindowFiles(D.InputPartition):
    """One window of one segment."""


class Reader(D.DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema
        self.bounds = Bounds()

    def pushFilters(self, filters):
        spec = read_manifest(self.path).spec
        for f in filters:
            if tuple(getattr(f, "attribute", ())) == (spec.partition_column,):
                if type(f) in COMPARISONS:
                    self.bounds = self.bounds.meet(from_comparison(COMPARISONS[type(f)], f.value, spec.interval))
                elif isinstance(f, D.In):
                    some = Bounds.of()
                    for value in f.value:
                        some = some.join(from_comparison("=", value, spec.interval))
                    self.bounds = self.bounds.meet(some)
            yield f

    def partitions(self):
        manifest = read_manifest(self.path)
        held = [(s, p) for p, w in sorted(manifest.windows.items()) if self.bounds.holds(p) for s in w.segments]
        return [WindowFiles(x) for x in held] or [WindowFiles(None)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        segment, window = partition.value
        fs, root = open_folder(self.path)
        names = [f.name for f in self.schema]
        for f in fs.get_file_info(pa.fs.FileSelector(f"{root}/data/_v={segment}/_p={window}")):
            if f.base_name.endswith(".parquet"):
                with fs.open_input_file(f.path) as source:
                    yield from pa.parquet.ParquetFile(source).iter_batches(columns=names)


class WindrowDataSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "windrow"

    def schema(self) -> T.StructType:
        return read_manifest(self.options["path"]).spec.schema()

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options["path"], schema)
