"""Connected components of a graph given as pairs, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.session import scratch_path


def _contracted(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step. Edges are (hi, lo) with lo < hi."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = (
        both.join(least, "u")
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        .distinct()
    )
    least = large.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = large.join(least, "hi").where(F.col("lo") != F.col("m"))
    return (
        moved.select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        .unionAll(least.select("hi", F.col("m").alias("lo")))
        .distinct()
    )


def _unfinished(edges: DataFrame) -> bool:
    """Whether some vertex points to two others, or both points and is pointed to."""
    ends = edges.select(F.col("hi").alias("u"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.unionAll(edges.select(F.col("lo"), F.lit(0), F.lit(1)))
    seen = ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not seen.where(F.col("out") + F.col("into") > 1).isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """(vertex, component): the smallest vertex reachable, for each vertex that has
    one smaller than itself; all other vertices are their own component.

    `links` is any pairs in its two columns; nulls and loops link nothing. Each round
    is written to the shared folder, which also cuts the lineage: a lost executor
    costs a part of one round. Rounds grow with the logarithm of the longest chain. A
    hub is no hot key, because minima are combined before the shuffle and the joins
    are ordinary ones that Spark can split.
    """
    spark = links.sparkSession
    a, b = (F.col(f"`{c}`") for c in links.columns)
    edges = links.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    edges = edges.distinct()
    while True:
        path = scratch_path(spark, "components")
        edges.write.parquet(path)
        edges = spark.read.schema(edges.schema).parquet(path)
        if not _unfinished(edges):
            return edges.select(F.col("hi").alias("vertex"), F.col("lo").alias("component"))
        edges = _contracted(edges)
