"""Line-oriented text sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_prompt_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line) of UTF-8 text; a line ends at a line feed, a carriage return or both."""
    return spark.read.text(path).select(F.col("value").alias("line"))


def scan_policy_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line_pos, line) of rule lists; `line_pos` sorts as the lines stand in the files."""
    return spark.read.text(path).select(
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
        ).alias("line_pos"),
        F.col("value").alias("line"),
    )
