"""Named queries and, beside each, the same thing in SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from parchmill.session import scratch_path, ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark, str(Path(__file__).parent))
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return run(spark, sf_dir)

        key = name or run.__name__
        prepared.__name__ = key
        QUERIES[key] = prepared
        if sql is not None:
            SQL[key] = sql
        return run

    return register


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to all cores, for queries that work long on each row: a given
    table may be one file of one row group, which one task would read."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


_PREPARED: dict[tuple[str, str, str], str] = {}


def prepared(spark: SparkSession, sf: str, label: str, make: Callable[[str], object]) -> str:
    """A path that `make` has filled with a query's input, once in a session. So a second
    run of a query is a run of its operator alone."""
    key = (spark.sparkContext.applicationId, sf, label)
    if key not in _PREPARED:
        path = scratch_path(spark, label)
        make(path)
        _PREPARED[key] = path
    return _PREPARED[key]


def given(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
