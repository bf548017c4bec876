"""Tables of text elements to texts, in document order.

An element is (path, part_no, row_no, cell_no, text, keep). Positions count from
0 and are unique within a path. A text comes out in rows: (path, segment_no, text),
which joined in order are exactly the text. A row holds about SEGMENT_BYTES, so neither
a group nor a row grows with the largest document.

The text moves once, into ranges of (path, block of positions), which are sorted. Where a
segment ends follows from the bytes before an element; those of whole blocks are summed
before, on sizes alone, and enter each range as rows of their own at the head of their
block. A task then cuts its range as a stream. Only the segments at the two edges of a
range, which may go on in the next, move again to be stitched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmill.session import scratch_path

SEGMENT_BYTES = 4 << 20
# Positions whose bytes are summed together; rows of a sheet, parts of others.
BLOCK = 4096
# Position of the element that ends a row, after any cell.
ROW_END = 2_147_483_647

_CUT = ["path", "segment_no", "text", "giant", "edge", "part"]


class _Cutter:
    """Cuts a sorted range of pieces into segments, holding one open segment."""

    def __init__(self, segment_bytes: int):
        self.size = segment_bytes
        self.part = TaskContext.get().partitionId()
        self.path, self.number, self.offset = None, -1, 0
        self.held: list[bytes] = []
        self.giant = self.edge = False

    def _closed(self, edge: bool) -> Iterator[pa.RecordBatch]:
        if self.path is not None:
            text = pa.array([b"".join(self.held)], pa.binary()).cast(pa.string())
            flags = [pa.array([x]) for x in (self.giant, self.edge or edge)]
            number = pa.array([self.number], pa.int32())
            yield pa.RecordBatch.from_arrays([self.path, number, text, *flags, pa.array([self.part], pa.int32())], _CUT)

    def cut(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Segments that end in the batch. Its columns: path, the bytes before a block
        (in the row at its head, null in others) and piece."""
        paths, piece = batch.column(0), batch.column(2).cast(pa.string())
        start = pc.fill_null(batch.column(1), -1).to_numpy(zero_copy_only=False)
        n = len(batch)
        _, where, data = piece.buffers()
        ends = np.frombuffer(where, np.int32)[piece.offset : piece.offset + n + 1]
        before = (ends[:-1] - ends[0]).astype(np.int64)
        other = np.empty(n, bool)
        other[0] = self.path is None or self.path[0] != paths[0]
        other[1:] = pc.not_equal(paths.slice(1), paths.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        # Offsets count on from the last head of a block or beginning of a path.
        known = np.maximum.accumulate(np.where(other | (start >= 0), np.arange(n), -1))
        base = np.where(known >= 0, np.maximum(start[known], 0) - before[known], self.offset)
        offset = base + before
        number = offset // self.size
        begins = other | (number != np.concatenate([[self.number], number[:-1]]))
        first_range = self.path is None
        at = np.flatnonzero(begins)
        widths = np.diff(ends)
        head = int(at[0]) if len(at) else n
        if head:  # goes on with the open segment
            self.held.append(_bytes(data, ends[0], ends[head]))
            self.giant |= bool(widths[:head].max() >= self.size)
        if len(at):
            yield from self._closed(False)
            bounds = np.append(at, n)
            giant = np.maximum.reduceat(widths, at) >= self.size
            edge = np.zeros(len(at), bool)
            edge[0] = first_range and offset[0] > 0
            whole = len(at) - 1
            if whole:
                text = pa.StringArray.from_buffers(whole, pa.py_buffer(ends[bounds[:-1]].astype(np.int32)), data)
                yield pa.RecordBatch.from_arrays(
                    [
                        paths.take(pa.array(at[:-1])),
                        pa.array(number[at[:-1]].astype(np.int32)),
                        text,
                        pa.array(giant[:-1]),
                        pa.array(edge[:-1]),
                        pa.array(np.full(whole, self.part, np.int32)),
                    ],
                    _CUT,
                )
            last = int(at[-1])
            self.path, self.number = paths.slice(last, 1), int(number[last])
            self.held, self.giant, self.edge = [_bytes(data, ends[last], ends[n])], bool(giant[-1]), bool(edge[-1])
        self.offset = int(offset[-1] + widths[-1])

    def finish(self) -> Iterator[pa.RecordBatch]:
        yield from self._closed(True)


def _bytes(data: pa.Buffer | None, a: int, b: int) -> bytes:
    return data[int(a) : int(b)].to_pybytes() if data is not None and b > a else b""


def _segmented(pieces: DataFrame, major: list[str], minor: list[str], segment_bytes: int) -> DataFrame:
    """(path, segment_no, text) of (path, *major, *minor, piece) in order of the columns.

    Rows that share `major` and a block, by the first column of `minor`, are in one
    range. A null piece is empty; rows without a path are left out.
    """
    spark = pieces.sparkSession
    keys = ["path", *major, "_block"]
    sized = pieces.where(F.col("path").isNotNull()).withColumn("_block", F.floor(F.col(minor[0]) / BLOCK))
    sums = sized.groupBy(*keys).agg(F.sum(F.octet_length("piece").cast("long")).alias("_n"))
    before = Window.partitionBy("path").orderBy(*major, "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, F.sum("_n").over(before).alias("_start")).where("_start > 0")
    heads = starts.select("*", *[F.lit(None).cast(pieces.schema[c].dataType).alias(c) for c in (*minor, "piece")])
    everything = sized.withColumn("_start", F.lit(None).cast("long")).unionByName(heads)
    # Nulls come first, so a block's head stands before its pieces.
    ranged = everything.repartitionByRange(*keys).sortWithinPartitions(*keys, *minor, "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(segment_bytes)
        for batch in batches:
            if len(batch):
                yield from cutter.cut(batch)
        yield from cutter.finish()

    kind = pieces.schema["path"].dataType.simpleString()
    ddl = f"path {kind}, segment_no int, text string, giant boolean, edge boolean, part int"
    stored = scratch_path(spark, "segments")
    ranged.select("path", "_start", "piece").mapInArrow(run, ddl).write.parquet(stored)
    cut = spark.read.schema(ddl).parquet(stored)
    parts = F.sort_array(F.collect_list(F.struct("part", "text")))
    stitched = cut.where("edge").groupBy("path", "segment_no").agg(parts.alias("_o"), F.max("giant").alias("giant"))
    stitched = stitched.select(
        "path", "segment_no", F.array_join(F.transform("_o", lambda p: p["text"]), "").alias("text"), "giant"
    )
    made = cut.where("NOT edge").select("path", "segment_no", "text", "giant").unionByName(stitched)
    long = cut.where("giant").select("path").distinct()
    if long.isEmpty():
        return made.drop("giant")
    # An element longer than a segment leaves out numbers, which are closed up here.
    number = F.row_number().over(Window.partitionBy("path").orderBy("segment_no")) - 1
    renumbered = made.join(long, "path", "left_semi").withColumn("segment_no", number.cast("int"))
    return made.join(long, "path", "left_anti").unionByName(renumbered).drop("giant")


def join_paragraphs(elements: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Word text: paragraphs with a line feed between them; a later segment begins with
    the one that divides it from the segment before."""
    piece = F.concat(F.lit("\n"), F.col("text")).alias("piece")
    joined = _segmented(elements.select("path", "part_no", piece), [], ["part_no"], segment_bytes)
    text = F.when(F.col("segment_no") == 0, F.expr("substring(text, 2)")).otherwise(F.col("text"))
    return joined.withColumn("text", text)


def concat_pages(elements: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """PDF text: pages with nothing between them."""
    pieces = elements.select("path", "part_no", F.col("text").alias("piece"))
    return _segmented(pieces, [], ["part_no"], segment_bytes)


def join_shapes(elements: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Slide text: a line feed after every shape, by slide and then shape (row_no)."""
    piece = F.concat("text", F.lit("\n")).alias("piece")
    pieces = elements.select("path", "part_no", "row_no", piece)
    return _segmented(pieces, [], ["part_no", "row_no"], segment_bytes)


def cell_piece(cell_no: Column, text: Column, keep: Column) -> Column:
    """What one workbook element adds to the text."""
    return (
        F.when(cell_no == ROW_END, F.lit("\n"))
        .when(keep, F.concat(text, F.lit("\t")))
        .otherwise(F.lit(""))
    )


def join_cells(elements: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Workbook text, sheets in order: a tab after every kept cell, a line feed after
    every row. Every row has a ROW_END element, so empty rows keep their line."""
    piece = cell_piece(F.col("cell_no"), F.col("text"), F.col("keep")).alias("piece")
    pieces = elements.select("path", "part_no", "row_no", "cell_no", piece)
    return _segmented(pieces, ["part_no"], ["row_no", "cell_no"], segment_bytes)
