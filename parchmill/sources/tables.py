"""Catalog, JDBC and in-memory tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def _quote(part: str) -> str:
    if not part:
        raise ValueError("empty identifier")
    return "`" + part.replace("`", "``") + "`"


def table_name(database: str, table: str) -> str:
    """A quoted two-part name; the parts are identifiers, never SQL text."""
    return f"{_quote(database)}.{_quote(table)}"


def scan_table(spark: SparkSession, database: str, table: str) -> DataFrame:
    """All columns of a catalog table; Spark prunes what the query does not use."""
    return spark.table(table_name(database, table))


def scan_jdbc(
    spark: SparkSession,
    url: str,
    database: str,
    table: str,
    driver: str | None = None,
    partition_column: str | None = None,
    lower_bound: int | str | None = None,
    upper_bound: int | str | None = None,
    num_partitions: int | None = None,
    one_task: bool = False,
    fetch_size: int = 10_000,
    quote: str = '"',
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A whole table over JDBC, split on a column, or in one task if that is asked for.

    The bounds only place the splits: rows outside them are still read, in the
    first and last part. Filters and column lists are pushed to the database. Names are
    identifiers, put in the database's `quote`, never SQL text. `properties` go to the
    driver: user, password and what else its login needs.
    """
    if not table:
        raise ValueError("empty identifier")
    parts = [database, table] if database else [table]
    options = {
        "url": url,
        "dbtable": ".".join(quote + p.replace(quote, quote * 2) + quote for p in parts),
        "fetchsize": str(fetch_size),
        **(properties or {}),
    }
    if driver:
        options["driver"] = driver
    split = (partition_column, lower_bound, upper_bound, num_partitions)
    if any(v is not None for v in split):
        if any(v is None for v in split):
            raise ValueError("give the partition column, both bounds and the number together")
        options.update(
            partitionColumn=partition_column,
            lowerBound=str(lower_bound),
            upperBound=str(upper_bound),
            numPartitions=str(num_partitions),
        )
    elif not one_task:
        raise ValueError("give a column to split on, or one_task=True to read in one task")
    return spark.read.format("jdbc").options(**options).load()


def local_rows(spark: SparkSession, rows: Iterable[tuple], columns: list[str]) -> DataFrame:
    """A DataFrame from rows the driver already holds."""
    return spark.createDataFrame(list(rows), columns)
