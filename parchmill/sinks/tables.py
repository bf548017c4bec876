"""Catalog-table sink."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from parchmill.sources.tables import table_name


class IncompleteLoad(RuntimeError):
    """What a load has written is not what it was given."""


def _described(spark: SparkSession, name: str) -> dict[str, str]:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()
    at = next(i for i, r in enumerate(rows) if r["col_name"] == "# Detailed Table Information")
    found = {r["col_name"]: r["data_type"] for r in rows[at + 1 :]}
    found["partitioned"] = str(any(r["col_name"] == "# Partition Information" for r in rows[:at]))
    return found


def load_table(df: DataFrame, database: str, table: str, path: str | None = None) -> None:
    """Create database.table from the frame's own schema, or replace its content.

    An existing table with the same columns gets its new content without a gap: the rows
    are written beside it and counted, then one change of its location shows them. So a
    load that fails on the way leaves the old content, readers never miss the table, and a
    table may be loaded from itself. With other columns (or where the table is partitioned
    or no Parquet table) the table is made anew under another name, which it gives up when
    the old one is dropped. Every load has a folder of its own, below the database's or
    beside `path`; the files of loads before stay for those that still read them, and
    dropping the table leaves its files, too.
    """
    spark = df.sparkSession
    name = table_name(database, table)
    mark = uuid.uuid4().hex
    if path is None:
        folder = spark.catalog.getDatabase("`" + database.replace("`", "``") + "`").locationUri
        path = f"{folder.rstrip('/')}/{table}"
    elif not spark.catalog.tableExists(name):
        df.write.mode("overwrite").format("parquet").option("path", path).saveAsTable(name)
        return
    place = f"{path.rstrip('/')}__load_{mark}"
    if not spark.catalog.tableExists(name):
        df.write.format("parquet").option("path", place).saveAsTable(name)
        return
    about = _described(spark, name)
    same = [(f.name, f.dataType) for f in spark.table(name).schema] == [(f.name, f.dataType) for f in df.schema]
    plain = about.get("Provider") == "parquet" and about["partitioned"] == "False" and "Num Buckets" not in about
    if same and plain:
        _written(df, place)
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{_text(place)}'")
        spark.catalog.refreshTable(name)
        return
    other = table_name(database, f"{table}__load_{mark}")
    df.write.format("parquet").option("path", place).saveAsTable(other)
    spark.sql(f"DROP TABLE {name}")
    spark.sql(f"ALTER TABLE {other} RENAME TO {name}")


def _text(value: str) -> str:
    return value.replace("\\", "\\\\").replace("'", "\\'")


def _written(df: DataFrame, place: str) -> None:
    given = Observation()
    df.observe(given, F.count(F.lit(1)).alias("n")).write.parquet(place)
    n = df.sparkSession.read.schema(df.schema).parquet(place).count()
    if n != given.get["n"]:
        raise IncompleteLoad(f"{place} has {n} of {given.get['n']} rows")
