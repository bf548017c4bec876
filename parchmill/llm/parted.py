"""Rows told apart by whether their key may be among others, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_EACH = 16  # of the bitmap, for each key
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28  # 32 MB at most


def parted(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be one of `keys`, rows whose key is none), together all rows.

    Use it before a join with few keys, so that only the first part has to be shuffled;
    that part holds all rows of the keys and about one in BITS_EACH of the others, or
    more once there are so many keys that the bitmap has its full size. `keys` has one
    column, and should be stored, as `rows` should: both are read twice.
    """
    n, bits = keys.count(), LEAST_BITS
    while bits < min(n * BITS_EACH, MOST_BITS):
        bits *= 2

    def bit(of: Column) -> Column:
        return F.pmod(F.xxhash64(of.cast("string")), F.lit(bits))

    one = bit(F.col(f"`{keys.columns[0]}`"))
    pieces = keys.select(one.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("__piece"))
    pieces = pieces.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("__bits"))
    held = rows.select("*", bit(key).alias("__bit"))
    held = held.join(F.broadcast(pieces), F.bitmap_bucket_number("__bit") == F.col("__piece"), "left")
    at = F.bitmap_bit_position("__bit")
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10)
    hit = F.expr("cast(bitmap_bit_position(__bit) % 8 as int)")
    hit = F.call_function("shiftright", byte.cast("int"), hit).bitwiseAND(F.lit(1)) == 1
    held = held.withColumn("__hit", F.coalesce(hit, F.lit(False))).drop("__bit", "__bits", "__piece")
    return held.where("__hit").drop("__hit"), held.where("NOT __hit").drop("__hit")
