"""A tree of document files as a Spark data source.

Its rows are the records that tasks cut files into (see operators.extract). Predicates on
path, kind and length are pushed down to the list of files, so files that no row is asked
of are never opened. The list is made by Spark before, and a partition is one of its
files: the driver plans with their number and holds no list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

from parchmill.formats.storage import resolve
from parchmill.operators import extract
from parchmill.session import scratch_path
from parchmill.sources.documents import deal_documents

FORMAT = "document_tree"
_ASKED = ("path", "kind", "length")
_TESTS = {
    EqualTo: pc.equal,
    GreaterThan: pc.greater,
    GreaterThanOrEqual: pc.greater_equal,
    LessThan: pc.less,
    LessThanOrEqual: pc.less_equal,
    StringStartsWith: pc.starts_with,
    StringEndsWith: pc.ends_with,
    StringContains: pc.match_substring,
}


def _pushable(f: Filter) -> bool:
    return len(getattr(f, "attribute", ())) == 1 and f.attribute[0] in _ASKED and type(f) in (*_TESTS, In, IsNotNull)


def _passes(f: Filter, files: pa.Table) -> pa.ChunkedArray:
    column = files.column(f.attribute[0])
    if isinstance(f, IsNotNull):
        return pc.is_valid(column)
    if isinstance(f, In):
        return pc.is_in(column, pa.array(list(f.value), column.type))
    return _TESTS[type(f)](column, f.value)


@dataclass
class ListFile(InputPartition):
    path: str


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.listing, self.strings = options["listing"], options.get("strings")
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if _pushable(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[ListFile]:
        fs, root = resolve(self.listing)
        found = fs.get_file_info(pafs.FileSelector(root))
        names = sorted(i.path for i in found if i.path.endswith(".parquet"))
        return [ListFile(n) for n in names] or [ListFile("")]

    def read(self, partition: ListFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = resolve(self.listing)
        files = pq.read_table(partition.path, filesystem=fs, partitioning=None)
        for f in self.filters:
            files = files.filter(_passes(f, files))
        cutters = extract.cutters(self.strings)
        for row in files.to_pylist():
            for batch in self._cut(row, cutters):
                yield batch.append_column("length", pa.array([row["length"]] * len(batch), pa.int64()))

    @staticmethod
    def _cut(row: dict, cutters: dict) -> Iterator[pa.RecordBatch]:
        if row["error"] is not None:
            yield extract.batch_of([(row["path"], row["kind"], 0, True, None, "error", row["error"])])
            return
        one = pa.RecordBatch.from_pydict(
            {"path": [row["path"]], "kind": [row["kind"]], "content": pa.array([None], pa.binary())}
        )
        yield from extract.cut_batches(iter([one]), cutters)


class DocumentTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return extract.PARSED_DDL + ", length bigint"

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def scan_tree(spark: SparkSession, root: str, tasks: int | None = None) -> DataFrame:
    """The records of all files below `root`, with path, kind and length.

    Hidden files are in it like others; files that cannot be read, empty ones and those
    of other kinds are a row that says so. Filters on path, kind and length decide which
    files are opened. Give the result to operators.extract.document_texts() once it is
    stored, as each use of it opens the files again. A session setting of Spark's lets
    predicates through to sources in Python, which is set here.
    """
    listing = scratch_path(spark, "tree")
    deal_documents(spark, root, tasks).write.parquet(listing)
    spark.dataSource.register(DocumentTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format(FORMAT).option("listing", listing)
    folder = extract.strings_folder(spark)
    return (reader.option("strings", folder) if folder else reader).load()
