"""Numbers for rows, whose ids may be missing or repeated."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmill.session import scratch_path


def numbered(docs: DataFrame, *columns: Column, key: str = "key") -> DataFrame:
    """The given columns of the rows, and `key`: a number of each row's own.

    Rows of files have the number of their file and their place in it, the same in every
    scan, so that nothing is written but the list of files. Other rows are written down
    with their numbers. The caller names all columns, so none of the table's can clash.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "rows")
    try:
        hidden = docs.metadataColumn("_metadata")
        rows = docs.select(*columns, hidden["file_path"].alias("__file"), hidden["row_index"].alias("__at"))
    except AnalysisException:  # no file, or none that numbers its rows
        rows = docs.select(*columns, F.monotonically_increasing_id().alias(key))
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)
    files = docs.select(hidden["file_path"].alias("__its")).distinct()
    files = files.withColumn("__n", F.row_number().over(Window.orderBy("__its")).cast("long"))
    files.write.parquet(path)
    files = spark.read.schema(files.schema).parquet(path)
    number = F.shiftleft("__n", 40).bitwiseOR(F.col("__at")).alias(key)
    joined = rows.join(files, F.col("__file") == F.col("__its"))
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns[:-2]], number)
