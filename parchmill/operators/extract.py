"""Document files to texts.

A task cuts each file into records (paragraphs, shapes, rows, pages) as a stream and
hands them on in rows of about SEGMENT_BYTES, so it holds a piece of a file and not the
file. The rows are written once to the shared folder. Spark expressions make the texts
where their row is: nothing moves. A broken file is a row with an error.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from parchmill.formats import cut, storage
from parchmill.operators.assemble import SEGMENT_BYTES, cell_piece
from parchmill.operators.cells import paragraph_text, row_cells, shape_text
from parchmill.operators.route import UNSUPPORTED, route
from parchmill.session import scratch_path

# What Python hands back at a time.
_BATCH_ROWS = 64
_BATCH_BYTES = 16 << 20

Element = tuple  # part_no, part_name, row_no, cell_no, text, keep
Parser = Callable[[BinaryIO], Iterator[Element]]

_RECORD = pa.struct(
    [
        ("part_no", pa.int32()),
        ("part_name", pa.string()),
        ("row_no", pa.int32()),
        ("what", pa.string()),
        ("content", pa.string()),
        ("gap", pa.int32()),
        ("cell_no", pa.int32()),
        ("keep", pa.bool_()),
    ]
)
_PARSED = pa.schema(
    [
        ("path", pa.string()),
        ("kind", pa.string()),
        ("segment_no", pa.int32()),
        ("is_last", pa.bool_()),
        ("records", pa.list_(_RECORD)),
        ("status", pa.string()),
        ("error", pa.string()),
    ]
)
PARSED_DDL = (
    "path string, kind string, segment_no int, is_last boolean, records array<struct<part_no:int,"
    "part_name:string,row_no:int,what:string,content:string,gap:int,cell_no:int,keep:boolean>>, "
    "status string, error string"
)

def cutters(strings: str | None) -> dict[str, Callable[[BinaryIO], Iterator[cut.Record]]]:
    """What cuts files of each kind; `strings` is strings_folder()."""
    books = cut.workbook(first_sheet_only=False, strings_folder=strings)
    return {"docx": cut.word, "xlsx": books, "pdf": cut.pdf, "pptx": cut.slides}


def strings_folder(spark: SparkSession) -> str | None:
    """Where tasks put shared strings that take much room; none where storage is out of
    their reach."""
    folder = scratch_path(spark, "strings")
    return folder if storage.reachable(folder) else None


def _own(parser: Parser) -> Callable[[BinaryIO], Iterator[tuple]]:
    def records(source: BinaryIO) -> Iterator[tuple]:
        for part_no, part_name, row_no, cell_no, text, keep in parser(source):
            yield part_no, part_name, row_no, "text", text, 0, cell_no, keep

    return records


def _segments(records: Iterator[tuple]) -> Iterator[tuple[int, bool, list[tuple]]]:
    """(number, whether it is the last, records)."""
    piece: list[tuple] = []
    number, size = 0, 0
    for r in records:
        n = len(r[4].encode()) + 64
        if piece and size + n > SEGMENT_BYTES:
            yield number, False, piece
            number, piece, size = number + 1, [], 0
        piece.append(r if len(r) == len(_RECORD) else (*r, None, None))
        size += n
    yield number, True, piece


def _rows_of(path: str, kind: str, content: pa.Buffer | None, parser: Callable) -> Iterator[tuple]:
    if kind == UNSUPPORTED:
        yield path, kind, 0, True, None, UNSUPPORTED, None
        return
    sent = -1
    try:
        with io.BytesIO(content) if content is not None else storage.open_file(path) as source:
            for number, last, piece in _segments(parser(source)):
                yield path, kind, number, last, piece, "ok", None
                sent = max(sent, number)
    except Exception as e:  # one bad file is a row, not a failed job
        # Rows of the file that have left already go before this one.
        yield path, kind, sent + 1, True, None, "error", f"{type(e).__name__}: {e}"


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = [
        _records_of(column) if f.name == "records" else pa.array(column, f.type)
        for f, column in zip(_PARSED, zip(*rows, strict=True), strict=True)
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_PARSED)


def _records_of(pieces: Sequence[list[tuple] | None]) -> pa.Array:
    """Lists of records, made a field at a time."""
    offsets, flat = [], []
    for piece in pieces:
        offsets.append(None if piece is None else len(flat))
        flat.extend(piece or ())
    columns = zip(*flat, strict=True) if flat else [()] * len(_RECORD)
    records = [pa.array(c, f.type) for c, f in zip(columns, _RECORD, strict=True)]
    made = pa.StructArray.from_arrays(records, fields=list(_RECORD))
    return pa.ListArray.from_arrays(pa.array([*offsets, len(flat)], pa.int32()), made)


def cut_batches(
    batches: Iterator[pa.RecordBatch], parsers: Mapping[str, Callable]
) -> Iterator[pa.RecordBatch]:
    """What cut_files() gives, of batches of (path, kind, content)."""
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for path, kind, content in zip(
            batch.column("path").to_pylist(),
            batch.column("kind").to_pylist(),
            batch.column("content"),
            strict=True,
        ):
            data = content.as_buffer() if content.is_valid else None
            for row in _rows_of(path, kind, data, parsers.get(kind)):
                rows.append(row)
                size += sum(len(r[4]) for r in row[4] or ())
                if len(rows) >= _BATCH_ROWS or size >= _BATCH_BYTES:
                    yield batch_of(rows)
                    rows, size = [], 0
    if rows:
        yield batch_of(rows)


def cut_files(files: DataFrame, parsers: Mapping[str, Callable]) -> DataFrame:
    """(path, kind, segment_no, is_last, records, status, error) of (path, kind, content)
    rows, cut once by the function for their kind and written to the shared folder."""
    cut_up = files.select("path", "kind", "content").mapInArrow(
        lambda batches: cut_batches(batches, parsers), PARSED_DDL
    )
    path = scratch_path(files.sparkSession, "parsed")
    cut_up.write.parquet(path)
    return files.sparkSession.read.schema(PARSED_DDL).parquet(path)


def parse_documents(files: DataFrame, parsers: Mapping[str, Parser] | None = None) -> DataFrame:
    """The records of (path, content) rows, as cut_files() gives them.

    Null content means that the task opens the file by its path. Unsupported files have
    a row that says so and are not opened. `parsers` replaces the parser of a kind: a
    function from an open file to its elements in order, each (part_no, part_name,
    row_no, cell_no, text, keep).
    """
    chosen = {**cutters(strings_folder(files.sparkSession)), **{k: _own(p) for k, p in (parsers or {}).items()}}
    routed = route(files.select("path", "content"))
    content = F.when(F.col("kind") != UNSUPPORTED, F.col("content"))
    return cut_files(routed.withColumn("content", content), chosen)


def _cells(what: Column, content: Column, cell_no: Column, keep: Column, formulas: bool) -> Column:
    """The cells of one record of a workbook, an element of a user's parser being one."""
    own = F.struct(cell_no.alias("cell_no"), content.alias("text"), F.lit("string").alias("kind"), keep.alias("keep"))
    return F.when(what == "text", F.array(own)).otherwise(row_cells(content, what, formulas))


def _text_of(what: Column, content: Column) -> Column:
    return (
        F.when(what.startswith("paragraph"), paragraph_text(content))
        .when(what.startswith("shape"), shape_text(content))
        .otherwise(content)
    )


def document_elements(parsed: DataFrame) -> DataFrame:
    """One row per element, for users who want cells, pages or shapes: (path, kind,
    part_no, part_name, row_no, cell_no, text, keep)."""
    records = parsed.where("kind <> 'xlsx'").select("path", "kind", F.inline("records"))
    texts = records.select(
        "path",
        "kind",
        "part_no",
        "part_name",
        "row_no",
        "cell_no",
        _text_of(F.col("what"), F.col("content")).alias("text"),
        F.coalesce("keep", F.lit(True)).alias("keep"),
    )
    books = parsed.where("kind = 'xlsx'").select("path", "kind", F.inline("records"))
    place = ("path", "kind", "part_no", "part_name", "row_no")
    cells = _cells(F.col("what"), F.col("content"), F.col("cell_no"), F.col("keep"), formulas=True)
    each = books.select(*place, F.explode(cells).alias("c"))
    return texts.unionByName(each.select(*place, "c.cell_no", "c.text", "c.keep"))


def _row_text(r: Column) -> Column:
    """A tab after every kept cell, a line feed after every row, also after those that
    the file leaves out."""
    cells = _cells(r["what"], r["content"], r["cell_no"], r["keep"], formulas=True)
    pieces = F.transform(cells, lambda c: cell_piece(c["cell_no"], c["text"], c["keep"]))
    end = F.when((r["what"] == "text") | r["what"].endswith("+"), "").otherwise("\n")
    return F.concat(F.repeat(F.lit("\n"), r["gap"]), F.array_join(pieces, ""), end)


def _joined(kind: Column, records: Column) -> Column:
    """The text of a row of records; rows are joined as they are."""

    def piece(r: Column) -> Column:
        text = _text_of(r["what"], r["content"])
        first = (r["part_no"] == 0) | (r["what"] == "paragraph+")
        before = F.when((kind == "docx") & ~first, "\n").otherwise("")
        after = F.when((kind == "pptx") & (r["what"] != "shape+"), "\n").otherwise("")
        return F.when(kind == "xlsx", _row_text(r)).otherwise(F.concat(before, text, after))

    return F.array_join(F.transform(records, piece), "")


def document_texts(parsed: DataFrame) -> DataFrame:
    """(path, out_name, kind, segment_no, is_last, text, status, error).

    Nearly every file is one row. A text of more than SEGMENT_BYTES goes on in rows with
    segment_no 1, 2, ...; joined in order they are the text. A file that turns out
    broken late has an error row after the rows before the break.
    """
    columns = ("path", "out_name", "kind", "segment_no", "is_last", "text", "status", "error")
    text = F.when(F.col("records").isNotNull(), _joined(F.col("kind"), F.col("records")))
    return route(parsed.drop("kind")).withColumn("text", text).select(*columns)


def extract_texts(files: DataFrame) -> DataFrame:
    """Texts of (path, content) rows, with a row for unsupported files too."""
    return document_texts(parse_documents(files))


def _metric_columns() -> list[Column]:
    first = F.coalesce(F.col("segment_no"), F.lit(0)) == 0
    ok, failed = F.col("status") == "ok", F.col("status") == "error"
    return [
        F.count_if(first).alias("n_files"),
        (F.count_if(first & ok) - F.count_if(failed & ~first)).alias("n_ok"),
        F.count_if(failed).alias("n_errors"),
        F.count_if(F.col("status") == UNSUPPORTED).alias("n_unsupported"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"),
    ]


def extract_metrics(texts: DataFrame) -> DataFrame:
    """One row of counts over extraction results."""
    return texts.agg(*_metric_columns())


def observe_metrics(texts: DataFrame, observation: Observation) -> DataFrame:
    """The same counts, taken while another action runs."""
    return texts.observe(observation, *_metric_columns())
