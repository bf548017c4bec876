"""First sheets of many workbooks as one table."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmill.formats.cut import workbook
from parchmill.operators.cells import row_cells
from parchmill.operators.extract import cut_files, strings_folder
from parchmill.session import scratch_path

# Texts that stand for a missing value.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# The kinds of values as bits: those of a column, in all workbooks, are their union.
KINDS = ("bigint", "double", "boolean", "timestamp_ntz", "string")


class HeaderMismatch(ValueError):
    """The workbooks of one read do not have the same columns."""


def column_names(header: list[str | None]) -> list[str]:
    """Blank headers are named by position, repeated ones numbered."""
    seen: Counter = Counter()
    names = []
    for i, value in enumerate(header):
        name = f"Unnamed: {i}" if value is None else str(value)
        while seen[name] > 0:
            seen[name] += 1
            name = f"{name}.{seen[name] - 1}"
        seen[name] += 1
        names.append(name)
    return names


def _typed(c: Column) -> Column:
    """A cell with a kind that the type inference tells apart, kind null if it has no
    value: error cells and texts that stand for a missing value have none; a text that
    reads like an error is a text."""
    missing = (c["kind"] == "error") | ((c["kind"] == "string") & c["text"].isin(*MISSING))
    number = F.when(c["kind"] == "double", c["text"].try_cast("double"))
    whole = F.coalesce((F.abs(number) < 2.0**63) & (number == F.floor(number)), F.lit(False))
    text = F.when(whole, number.cast("bigint").cast("string")).otherwise(c["text"])
    kind = F.when(~missing, F.when(whole, "bigint").otherwise(c["kind"]))
    return F.struct(c["cell_no"].alias("cell_no"), text.alias("text"), kind.alias("kind"))


def _names(header: list, width: int) -> list[str]:
    """Names of the columns of a first row; columns right of it have none of their own."""
    texts: list[str | None] = [None] * max(width, 1 + max((h["cell_no"] for h in header), default=-1))
    for h in header:
        texts[h["cell_no"]] = h["text"]
    return column_names(texts)


def _cast(cell: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.BooleanType):
        return F.when(cell == "True", True).when(cell == "False", False)
    return cell.cast(data_type)


def _column_type(bits: int) -> str:
    """The type that holds all kinds of a column; one without a value is text."""
    seen = {k for i, k in enumerate(KINDS) if bits >> i & 1}
    if len(seen) == 1:
        return next(iter(seen))
    return "double" if seen == {"bigint", "double"} else "string"


def _inferred(found: dict[int, int], names: list[str]) -> T.StructType:
    quoted = (n.replace("`", "``") for n in names)
    return T.StructType.fromDDL(", ".join(f"`{n}` {_column_type(found.get(i, 0))}" for i, n in enumerate(quoted)))


def _places(heads: DataFrame, width: int, wanted: list[str]) -> DataFrame:
    """(path, names, place) of the first rows: where each wanted column stands, null if
    the workbook does not have exactly these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [_names(h, width) for h in batch.column("header").to_pylist()]
            place = [[n.index(c) for c in wanted] if sorted(n) == sorted(wanted) else None for n in names]
            columns = [batch.column("path"), pa.array(names, pa.list_(pa.string())), pa.array(place, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["path", "names", "place"])

    return heads.mapInArrow(run, "path string, names array<string>, place array<int>")


def read_workbooks(files: DataFrame, schema: T.StructType | str | None = None) -> DataFrame:
    """The first sheet of each (path, content) row; its first filled row names the columns.

    Tasks cut the sheets into rows with their shared strings in them. Spark makes the
    cells, as an array in their row, which is written once to the shared folder, so that
    the rows of one large workbook are worked on by many tasks and none of them moves.
    Without a schema names and types are taken from all workbooks: whole numbers,
    numbers, truth values, dates and times without a zone, else text; the kinds of a
    column's values are bits that are merged, read without the values. Columns right of
    the last header are named by position. With a schema, workbooks may have its columns
    in any order. A row that gives a cell twice has the last one.
    """
    spark = files.sparkSession
    one = files.select("path", F.lit("xlsx").alias("kind"), "content")
    parsed = cut_files(one, {"xlsx": workbook(True, strings_folder(spark))})
    broken = parsed.where("status = 'error'").select("path", "error").head(1)
    if broken:
        raise ValueError(f"{broken[0]['path']}: {broken[0]['error']}")
    each = parsed.select("path", F.inline("records"))
    cells = F.filter(row_cells(F.col("content"), F.col("what"), formulas=False), lambda c: c["text"] != "")
    # A row in several pieces, which are long, is put together again.
    whole = F.col("what").isin("row", "row1904")
    columns = ("path", "part_no", "row_no", "gap", "cells")
    rows = each.withColumn("cells", cells)
    parts = rows.where(~whole).groupBy("path", "part_no", "row_no")
    parts = parts.agg(F.max("gap").alias("gap"), F.array_sort(F.flatten(F.collect_list("cells"))).alias("cells"))
    stored = scratch_path(spark, "cells")
    made = rows.where(whole).select(*columns).unionByName(parts.select(*columns))
    typed = F.when(F.col("part_no") == 1, F.filter(F.transform("cells", _typed), lambda c: c["kind"].isNotNull()))
    made = made.withColumn("typed", typed).withColumn("cells", F.when(F.col("part_no") == 0, F.col("cells")))
    made.write.parquet(stored)
    made = spark.read.schema(made.schema).parquet(stored)

    entry = F.transform("cells", lambda c: F.struct(c["cell_no"].alias("cell_no"), c["text"].alias("text")))
    heads = made.where("part_no = 0").select("path", entry.alias("header"))
    first = heads.head(1)
    if not first:
        raise ValueError("no header in any workbook")
    kind = F.element_at(F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(1 << i))]), F.col("k"))
    kinds = made.select(F.explode(F.arrays_zip(F.col("typed.cell_no").alias("i"), F.col("typed.kind").alias("k"))).alias("c"))
    kinds = kinds.select("c.i", "c.k").groupBy("i").agg(F.bit_or(kind).alias("bits"))
    found = {r["i"]: r["bits"] for r in kinds.collect()}  # one row a column
    width = 1 + max(found, default=-1)
    names = _names(first[0]["header"], width)
    if schema is None:
        wanted = _inferred(found, names)
    else:
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    placed = _places(heads, width, wanted.fieldNames())
    other = placed.where(F.col("place").isNull() | (F.lit(schema is None) & (F.col("names") != F.array(*map(F.lit, names)))))
    other = other.select("names").head(1)
    if other:
        raise HeaderMismatch(f"expected {wanted.fieldNames()}, found {other[0]['names']}")

    rows = made.where("part_no = 1").select("path", "gap", "typed")
    if len(wanted) > 1:  # rows without a value before a filled one are rows too
        empty = F.filter("typed", lambda c: F.lit(False))
        copies = F.concat(F.array_repeat(empty, F.col("gap")), F.array("typed"))
        rows = rows.select("path", F.explode(copies).alias("typed"))
    alike = placed.select("place").distinct().limit(2).collect()
    if len(alike) == 1:
        place = [F.lit(p) for p in alike[0]["place"]]
    else:
        rows = rows.join(placed.select("path", "place"), "path")
        place = [F.get("place", F.lit(i)) for i in range(len(wanted))]
    rows = rows.withColumn("cells", F.map_from_entries(F.transform("typed", lambda c: F.struct(c["cell_no"], c["text"]))))
    return rows.select(
        *[
            _cast(F.try_element_at("cells", place[i]), f.dataType).alias(f.name)
            for i, f in enumerate(wanted.fields)
        ]
    )


def scan_excel(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None
) -> DataFrame:
    """First sheets of the workbooks at a path, folder or pattern on any storage."""
    return read_workbooks(spark.read.format("binaryFile").load(path), schema)
