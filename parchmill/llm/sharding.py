"""A global shuffle into shards in two passes over the data.

Pass one scatters the rows by seeded hashes: the id alone decides the shard, a hash of
the row the bucket inside it. Buckets are sized to fit in a task's memory. Pass two
reads each bucket, puts it in Fisher-Yates order and writes it to its shard's folder.
Only pass one shuffles; its partitions feed pass two directly.

The law of the shards is `key`: the id and the number of shards decide. A shard is the
one of the highest seeded hash for the id, so one more shard takes rows to itself and
moves none between the others.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from parchmill.session import scratch_path

BUCKET_BYTES = 32 << 20


def consistent_shard(id_value: Column, shards: int, seed: int) -> Column:
    """The shard of highest hash. A null id counts as a value like others."""
    votes = F.array(*[F.xxhash64(F.lit(seed), F.lit(k), id_value) for k in range(shards)])
    return (F.array_position(votes, F.array_max(votes)) - 1).cast("int")


def _row_bytes(docs: DataFrame) -> Column:
    """About how much a row holds, in all its columns."""
    total = F.lit(8).cast("long")
    for f in docs.schema.fields:
        value = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(value), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(value))), F.lit(0))
        else:
            total = total + 8
    return total


def write_shards(
    docs: DataFrame,
    path: str,
    shards: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 20,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Write all rows to folders shard=0, shard=1, ... below `path`; returns what is there.

    Columns: shard int, bucket int, place long (order in its bucket, from 0), and row,
    a struct with all columns of `docs`, so their names clash with nothing. Files hold
    rows in order of bucket and place. The same rows and seed give the same shards,
    buckets and places, however the input is split; only rows of equal id and text that
    together hold more than a quarter of a bucket are spread by their place in the input,
    so that a bucket holds about `bucket_bytes`, all columns counted, or one longer row.
    Rows with null ids or texts are kept; repeated rows too; an empty table writes an
    empty one. A very long text has a bucket of its own size. `path` must be on storage that all executors share, and must not exist.
    Lost tasks are done again from the input.
    """
    spark = docs.sparkSession
    id_value, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    mark = F.xxhash64(F.lit(seed), id_value, text)
    counted = docs.select(mark.alias("m"), _row_bytes(docs).alias("b")).groupBy("m")
    counted = counted.agg(F.sum("b").alias("b"), F.count(F.lit(1)).alias("n"))
    found = scratch_path(spark, "marks")
    counted.write.parquet(found)
    counted = spark.read.schema(counted.schema).parquet(found)
    total = counted.agg(F.coalesce(F.sum("b"), F.lit(0))).first()[0]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = math.ceil(max(total / bucket_bytes, 4 * partitions) / shards)
    # Stored, so that Spark knows how few they are.
    heavy_path = scratch_path(spark, "heavy-marks")
    counted.where((F.col("n") > 1) & (F.col("b") > bucket_bytes / 4)).select("m").write.parquet(heavy_path)
    heavy = spark.read.schema("m long").parquet(heavy_path)

    taken = docs.select(
        consistent_shard(id_value, shards, seed).alias("shard"),
        mark.alias("mark"),
        F.monotonically_increasing_id().alias("at"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    ).join(heavy, F.col("mark") == F.col("m"), "left")
    spread = F.when(F.col("m").isNotNull(), F.col("at")).otherwise(F.lit(0))
    scattered = taken.select(
        "shard",
        (F.col("shard") * each + F.pmod(F.xxhash64("mark", spread), F.lit(each)).cast("int")).alias("bucket"),
        "mark",
        "row",
    )

    def fisher_yates(table: pa.Table) -> pa.Table:
        marks = table.column("mark").to_numpy()
        bucket = table.column("bucket")[0].as_py()
        rng = np.random.Generator(np.random.PCG64([seed, bucket]))
        order = np.argsort(marks, kind="stable")  # the order of arrival is chance
        order = order[rng.permutation(len(order))]
        place = pa.array(np.arange(len(order), dtype=np.int64))
        out = table.select(["shard", "bucket", "row"]).take(pa.array(order))
        return out.add_column(2, "place", place)

    schema = StructType.fromDDL("shard int, bucket int, place long")
    schema = schema.add("row", scattered.schema["row"].dataType)
    shuffled = scattered.groupBy("bucket").applyInArrow(fisher_yates, schema)
    ordered = shuffled.sortWithinPartitions("shard", "bucket", "place")
    ordered.write.partitionBy("shard").parquet(path)
    return spark.read.schema(schema).parquet(path)


def with_slots(written: DataFrame, *columns: Column) -> DataFrame:
    """Some columns of written shards with shard and `slot`, the row's place in its
    shard, without gaps from 0. Joins one row a bucket; moves no texts."""
    counts = written.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    named = written.select("bucket", "shard", "place", *columns)
    slot = (F.col("start") + F.col("place")).alias("slot")
    rest = [c for c in named.columns if c not in ("bucket", "place")]
    return named.join(starts, "bucket").select(*rest, slot)
