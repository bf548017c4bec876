"""Which parser a file goes to, and which files would share an output name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmill.functions.text import out_name

# The extensions of each kind of document.
EXTENSIONS = {
    "docx": ("docx",),
    "xlsx": ("xlsx", "xlsm", "xltx", "xltm"),
    "pdf": ("pdf",),
    "pptx": ("pptx",),
}
UNSUPPORTED = "unsupported"


def kind_of(path: Column) -> Column:
    """docx, xlsx, pdf, pptx or unsupported, by the end of the path in any case."""
    ending = F.lower(F.right(path, F.lit(5)))
    kind = F.lit(UNSUPPORTED)
    for name, extensions in EXTENSIONS.items():
        for extension in extensions:
            kind = F.when(ending.endswith("." + extension), name).otherwise(kind)
    return kind


def route(files: DataFrame) -> DataFrame:
    """Add kind and out_name to a table with a path."""
    return files.withColumn("kind", kind_of(F.col("path"))).withColumn(
        "out_name", out_name(F.col("path"))
    )


def unsupported_files(routed: DataFrame) -> DataFrame:
    return routed.where(F.col("kind") == UNSUPPORTED)


def output_collisions(routed: DataFrame) -> DataFrame:
    """(out_name, n_files, last_path) of names that more than one file would write.

    Counts combine before the shuffle, so a name shared by very many files is
    no burden.
    """
    return (
        routed.groupBy("out_name")
        .agg(F.count("*").alias("n_files"), F.max("path").alias("last_path"))
        .where("n_files > 1")
    )
