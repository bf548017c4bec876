"""Consecutive numbers for unique keys without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_HEX_DIGITS = 3  # 16**3 buckets: the offsets table has at most 4,096 rows


def number_by_key(df: DataFrame, key: str, out: str, start: int = 1) -> DataFrame:
    """Number rows from `start` in the order (first hex digits of SHA-256, key).

    Keys must be unique. Each bucket is numbered in its own task; the bucket
    sizes, 4,096 rows at most whatever the data, give every bucket its offset.
    """
    bucketed = df.withColumn("_bucket", F.left(F.sha2(F.col(key), 256), F.lit(_HEX_DIGITS)))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy("_bucket")
        .agg(F.count("*").alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    return (
        bucketed.withColumn("_rn", within)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(out, F.col("_offset") + F.col("_rn") + F.lit(start - 1))
        .drop("_bucket", "_offset", "_rn")
    )
