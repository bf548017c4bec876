"""The document job: a tree of files to a table of texts, and to text files."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from parchmill.operators.extract import document_texts, observe_metrics, parse_documents
from parchmill.operators.route import route
from parchmill.sinks.text_files import write_text_files
from parchmill.sources.documents import read_documents


class TooManyErrors(RuntimeError):
    """More files failed than the job allows."""


def extract_tree(spark: SparkSession, root: str, tasks: int | None = None) -> DataFrame:
    """(path, out_name, kind, segment_no, is_last, text, status, error) of every
    file below `root`; status is ok, error or unsupported."""
    files, unreadable = read_documents(spark, root, tasks)
    texts = document_texts(parse_documents(files))
    others = route(unreadable).withColumns({"segment_no": F.lit(0), "is_last": F.lit(True)})
    return texts.unionByName(others, allowMissingColumns=True)


def run_extraction(
    spark: SparkSession,
    root: str,
    table_path: str,
    text_folder: str | None = None,
    on_collision: str = "error",
    max_error_ratio: float | None = None,
    tasks: int | None = None,
) -> dict[str, float]:
    """Extract a tree to a Parquet table, then to text files if a folder is given.

    Files are parsed once: the counts are taken on the way and the text files are
    written from the table. `tasks` fixes how many tasks parse; left out, the file
    sizes decide. Returns the counts and the seconds taken.
    """
    started = time.monotonic()
    observation = Observation("extraction")
    observed = observe_metrics(extract_tree(spark, root, tasks), observation)
    observed.write.mode("overwrite").parquet(table_path)
    counts = dict(observation.get)
    if max_error_ratio is not None and counts["n_errors"] > max_error_ratio * counts["n_files"]:
        raise TooManyErrors(f"{counts['n_errors']} of {counts['n_files']} files failed")
    if text_folder:
        texts = spark.read.parquet(table_path)
        counts["n_written"] = write_text_files(texts, text_folder, on_collision).count()
    counts["seconds"] = round(time.monotonic() - started, 3)
    return counts
