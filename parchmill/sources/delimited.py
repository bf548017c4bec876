"""Comma-separated sources: typed with quotes, or raw."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmill.formats.storage import open_file
from parchmill.functions.text import split_fields, strip


def scan_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None
) -> DataFrame:
    """CSV with a header. Types are inferred, which reads the data once more;
    give a schema to read it only once."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.csv(path, inferSchema=True)


class HeaderMismatch(ValueError):
    """The files of one read disagree on their header."""


def raw_header(spark: SparkSession, path: str | list[str]) -> str:
    """The header line that all files share.

    One line a file is read: a line reader stops after its first row, and what the
    driver gets is one row, whatever the number of files.
    """

    def first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                with open_file(file) as source:
                    line = source.readline()
                if line:
                    text = line.removesuffix(b"\n").decode("utf-8", "replace")
                    yield pa.RecordBatch.from_pydict({"line": [text]})

    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))
    heads = files.mapInArrow(first_lines, "line string").select(strip(F.col("line")).alias("line"))
    found = heads.agg(F.min("line").alias("a"), F.max("line").alias("b")).first()
    if found["a"] is None:
        raise ValueError(f"no lines in {path}")
    if found["a"] != found["b"]:
        raise HeaderMismatch(f"two headers: {found['a']!r} and {found['b']!r}")
    return found["a"]


def _without_first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines without the first one of each file. Rows of a file's first block follow
    each other, so a line is the first of its file if the line before is of another."""
    before = None
    for batch in batches:
        file = batch.column("file").to_numpy()
        same = np.empty(len(file), bool)
        if len(file):
            same[0], same[1:] = before is not None and file[0] == before, file[1:] == file[:-1]
            before = file[-1]
        head = batch.column("first_block").to_numpy(zero_copy_only=False) & ~same
        yield pa.RecordBatch.from_arrays([batch.column("line").filter(pa.array(~head))], ["line"])


def _data_lines(
    spark: SparkSession, path: str | list[str], columns: list[str] | None
) -> tuple[list[str], DataFrame]:
    names = columns if columns is not None else raw_header(spark, path).split(",")
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("value").alias("line"),
        F.xxhash64("_metadata.file_path").alias("file"),
        (F.col("_metadata.file_block_start") == 0).alias("first_block"),
    )
    data = lines.mapInArrow(_without_first_lines, "line string")
    return names, data.select(strip(F.col("line")).alias("line"))


def scan_csv_raw(
    spark: SparkSession,
    path: str | list[str],
    on_long: str = "error",
    columns: list[str] | None = None,
) -> DataFrame:
    """Comma-split lines, all columns text, names from the first line of each file.

    Quotes have no meaning. A short line is filled up with nulls. A line with
    more fields than the header fails the read, or is left out (`on_long=
    "reject"`) and can be had from `raw_rejects`.

    The data are read once, without a join or shuffle. Before that one line a file is
    read to see that all have the same header, on storage that Python can reach; with
    `columns` given nothing is, and each file's first line is left out unseen.
    """
    if on_long not in ("error", "reject"):
        raise ValueError("on_long must be 'error' or 'reject'")
    names, lines = _data_lines(spark, path, columns)
    rows = lines.withColumn("fields", split_fields(F.col("line"), ","))
    if on_long == "reject":
        rows = rows.where(F.size("fields") <= len(names))

    def field(i: int) -> Column:
        value = F.get("fields", F.lit(i))
        if on_long == "error":
            too_long = F.concat(F.lit(f"more than {len(names)} fields: "), F.col("line"))
            return F.when(F.size("fields") > len(names), F.raise_error(too_long)).otherwise(value)
        return value

    return rows.select(*[field(i).alias(f"_c{i}") for i in range(len(names))]).toDF(*names)


def raw_rejects(
    spark: SparkSession, path: str | list[str], columns: list[str] | None = None
) -> DataFrame:
    """(line, n_fields) of the lines with more fields than the header."""
    names, lines = _data_lines(spark, path, columns)
    n = F.size(split_fields(F.col("line"), ","))
    return lines.select("line", n.alias("n_fields")).where(F.col("n_fields") > len(names))
