"""One UTF-8 text file per document in a flat folder, and what is in such a folder."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from itertools import groupby, islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.formats.storage import resolve
from parchmill.operators.route import output_collisions
from parchmill.session import full_uri, scratch_path
from parchmill.sources.documents import deal_documents

_DDL = "path string, out_name string, n_bytes bigint"
# What a task says of its files, and its files' texts, go on in batches of so many rows or bytes.
_BATCH_ROWS, _BATCH_BYTES = 1000, 4 << 20


class OutputCollision(ValueError):
    """Several documents would be written to the same file."""


def _replace(fs: pafs.FileSystem, partial: str, name: str) -> None:
    try:
        fs.move(partial, name)
    except OSError:
        if fs.get_file_info(partial).type == pafs.FileType.NotFound:
            if fs.get_file_info(name).type == pafs.FileType.File:
                return  # a task that ran before has done it
            raise
        fs.delete_file(name)  # some file systems do not rename onto a file
        fs.move(partial, name)


def _texts(
    batches: Iterator[pa.RecordBatch],
) -> Iterator[tuple[tuple[str, str], Iterator[pa.StringScalar]]]:
    """((path, out_name), segments) per text; a text starts at each segment 0."""

    def numbered() -> Iterator[tuple]:
        n = 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("path", "out_name", "segment_no"))
            for path, name, segment_no, text in zip(*columns, batch.column("text"), strict=True):
                n += segment_no == 0
                yield (n, path, name), text

    for (_, path, name), rows in groupby(numbered(), key=lambda r: r[0]):
        yield (path, name), (text for _, text in rows)


def _write(batches: Iterator[pa.RecordBatch], partials: str) -> Iterator[pa.RecordBatch]:
    """path, out_name, n_bytes and partial: the file that has the text."""
    fs, beside = resolve(partials)
    fs.create_dir(beside, recursive=True)

    def written() -> Iterator[tuple]:
        for (path, name), pieces in _texts(batches):
            partial, n_bytes, complete = uuid.uuid4().hex, 0, True
            with fs.open_output_stream(f"{beside}/{partial}") as out:
                for text in pieces:
                    complete = complete and text.is_valid
                    if complete:
                        data = text.as_buffer()
                        out.write(data)
                        n_bytes += data.size
            if complete:
                yield path, name, n_bytes, partial

    files = written()
    while some := list(islice(files, _BATCH_ROWS)):
        path, name, n_bytes, partial = map(list, zip(*some, strict=True))
        text = [pa.array(c, pa.string()) for c in (path, name, partial)]
        columns = [text[0], text[1], pa.array(n_bytes, pa.int64()), text[2]]
        yield pa.RecordBatch.from_arrays(columns, ["path", "out_name", "n_bytes", "partial"])


def _named(written: DataFrame, on_collision: str) -> DataFrame:
    """Written texts with final_name; null for those that others replace."""
    clashes = output_collisions(written.select("path", "out_name"))
    if on_collision == "error":
        first = clashes.head(1)
        if first:
            raise OutputCollision(f"{first[0]['n_files']} files for {first[0]['out_name']}")
        return written.withColumn("final_name", F.col("out_name"))
    joined = written.join(clashes.select("out_name", "last_path"), "out_name", "left")
    alone = F.col("last_path").isNull()
    if on_collision == "last":
        name = F.when(alone | (F.col("last_path") == F.col("path")), F.col("out_name"))
    else:
        tagged = F.concat(
            F.regexp_replace("out_name", r"\.txt\z", "-"), F.sha2("path", 256), F.lit(".txt")
        )
        name = F.when(alone, F.col("out_name")).otherwise(tagged)
    return joined.withColumn("final_name", name).drop("last_path")


def write_text_files(texts: DataFrame, folder: str, on_collision: str = "error") -> DataFrame:
    """Write the texts that were extracted; returns (path, out_name, n_bytes).

    The texts are read once. Each is written beside the folder under a name of its own,
    by the task that has it; only texts of several rows are shuffled, to bring these
    together. The manifest has the names that tasks wrote which did not fail. Which names are shared is found on (path, out_name) alone, so
    a name that very many files share moves no text. Then the files are renamed into the
    folder, once each. A task that is lost leaves nothing there, and one that runs again
    writes other files or finds its files renamed. A file that turned out broken after some rows is not written.

    `on_collision`: "error" refuses names that several files share, "suffix" adds
    a hash of the path to them, "last" keeps the file with the greatest path.
    """
    if on_collision not in ("error", "suffix", "last"):
        raise ValueError("on_collision must be 'error', 'suffix' or 'last'")
    spark = texts.sparkSession
    folder = full_uri(spark, folder)
    names = ("path", "out_name", "segment_no", "text")
    ok = (F.col("status") == "ok") & F.col("text").isNotNull()
    whole = F.col("is_last") & (F.col("segment_no") == 0)
    # A broken file's last row has no text, which tells the writer to drop the file.
    parts = texts.where(~whole).select(*names).repartition("path")
    rows = texts.where(whole & ok).select(*names).unionAll(
        parts.sortWithinPartitions("path", "segment_no")
    )
    partials = f"{folder.rstrip('/')}.partial-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _write(batches, partials)

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, beside = resolve(partials)
        _, base = resolve(folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                _replace(fs, f"{beside}/{row['partial']}", f"{base}/{row['final_name']}")
            done = batch.set_column(1, "out_name", batch.column("final_name"))
            yield done.select(["path", "out_name", "n_bytes"])

    try:
        manifest = scratch_path(spark, "manifest")
        said = f"{_DDL}, partial string"
        rows.mapInArrow(write, said).write.parquet(manifest)
        named = _named(spark.read.schema(said).parquet(manifest), on_collision).where("final_name IS NOT NULL")
        named = named.select("path", "out_name", "n_bytes", "partial", "final_name")
        # Names are small, so few tasks would have them all; renaming takes its time by the file.
        named = named.repartition(spark.sparkContext.defaultParallelism)
        written = scratch_path(spark, "written")
        named.mapInArrow(rename, _DDL).write.parquet(written)
        return spark.read.schema(_DDL).parquet(written)
    finally:
        fs, beside = resolve(partials)
        with contextlib.suppress(OSError):  # what others replaced and lost tasks left
            fs.delete_dir(beside)


def read_text_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, text) of all files of a folder that write_text_files() filled.

    Executors list the folder, and the files are dealt out to tasks by size with a small
    charge for each; a scan of Spark's has the driver list them and a task for some 30.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, texts, size = [], [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["name", "text"])

        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, local = resolve(path)
                with fs.open_input_stream(local) as file:
                    texts.append(file.read())
                names.append(path.rpartition("/")[2])
                size += len(texts[-1])
                if size > _BATCH_BYTES or len(names) >= _BATCH_ROWS:
                    yield made()
                    names, texts, size = [], [], 0
        if names:
            yield made()

    return deal_documents(spark, folder).select("path").mapInArrow(read, "name string, text string")
