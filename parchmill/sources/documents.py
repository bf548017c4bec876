"""Trees of document files."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.formats.storage import children, qualified, reachable
from parchmill.operators.route import UNSUPPORTED, route
from parchmill.session import full_uri, scratch_path

_LISTED = "path string, kind string, length bigint, modified double, problem string"
_LISTED_ARROW = pa.schema(
    [
        ("path", pa.string()),
        ("kind", pa.string()),
        ("length", pa.int64()),
        ("modified", pa.float64()),
        ("problem", pa.string()),
    ]
)
# How files are dealt out to tasks: by size, with a charge per file.
_BYTES_PER_TASK = 128 << 20
_OPEN_COST = 256 << 10


class Unreachable(OSError):
    """Python cannot reach a storage by itself."""


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder in batch.column("path").to_pylist():
            entries = children(folder)
            while some := list(islice(entries, 10_000)):
                columns = [pa.array(c, t) for c, t in zip(zip(*some), _LISTED_ARROW.types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=_LISTED_ARROW)


def _listing(spark: SparkSession, root: str) -> DataFrame:
    """Every entry below `root` that is not a folder itself."""
    out = scratch_path(spark, "listing")
    level, folders = 0, spark.createDataFrame([(qualified(root).rstrip("/"),)], "path string")
    while True:
        here = f"{out}/level={level}"
        listed = folders.repartition(spark.sparkContext.defaultParallelism)
        listed.mapInArrow(_list_folders, _LISTED).write.parquet(here)
        folders = spark.read.schema(_LISTED).parquet(here).where("kind = 'folder'").select("path")
        if folders.isEmpty():
            break
        level += 1
    listed = spark.read.schema(_LISTED + ", level int").parquet(out).drop("level")
    return listed.where("kind <> 'folder'")


def list_documents(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified, problem) of every file below `root`, hidden and
    empty ones too; links to folders are not followed.

    One job per level of the tree: executors list the folders of a level, and the
    folders they find are the next level. The driver holds no file list, and a
    level once written is not listed again if an executor is lost. `problem` is
    null but for folders that cannot be listed and links to nothing.
    """
    modified = F.timestamp_seconds("modified").alias("modified")
    files = _listing(spark, full_uri(spark, root)).where("kind = 'file'")
    return files.select("path", "length", modified, "problem")


def scan_visible(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the files below `root` that a scan of Spark's sees, on any
    storage that Spark can reach. It passes over hidden names and files that do not fit
    a row, so this reads a part of a tree: ask for it by name."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(re.sub(r"([\[\]{}*?\\])", r"\\\1", full_uri(spark, root)))
        .select("path", "content")
    )


def deal_documents(spark: SparkSession, root: str, tasks: int | None = None) -> DataFrame:
    """(path, kind, length, error) of every file of a tree, dealt out to tasks by size, or
    to the number given. `error` says why a file cannot be read, if it cannot, or has
    nothing in it though it should. Raises Unreachable as read_documents() does."""
    root = full_uri(spark, root)
    if not reachable(root):
        raise Unreachable(f"{root}: only Spark can reach this storage; see scan_visible")
    listed = route(_listing(spark, root).where("kind = 'file'").drop("kind"))
    supported = F.col("kind") != UNSUPPORTED
    empty = F.when(supported & (F.col("length") == 0), "empty file")
    files = listed.select("path", "kind", "length", F.coalesce("problem", empty).alias("error"))
    size = files.where("error IS NULL").agg(
        F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")
    ).first()
    n = tasks or max(1, math.ceil((size["bytes"] + size["files"] * _OPEN_COST) / _BYTES_PER_TASK))
    return files.repartition(n)


def read_documents(
    spark: SparkSession, root: str, tasks: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(files, files that cannot be read) of a tree.

    Files are (path, content) with null content: the task that parses a file opens it by
    its path, whatever its name and size, so the driver holds no file list and no row a
    file. They are dealt out to tasks by size, or to the number given. Files that cannot
    be read, or have nothing in them though they should, are (path, status, error). No
    file is left out. Raises Unreachable where only Spark can reach the storage;
    `scan_visible` reads what Spark's scan sees of it.
    """
    files = deal_documents(spark, root, tasks)
    no_content = F.lit(None).cast("binary").alias("content")
    unreadable = files.where("error IS NOT NULL").select("path", F.lit("error").alias("status"), "error")
    return files.where("error IS NULL").select("path", no_content), unreadable
