"""Apply column masks to a DataFrame on read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.functions.masks import mask


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def chosen_masks(
    policies: DataFrame, database: str, table: str, columns: list[str]
) -> dict[str, str]:
    """column -> option for one table; the last rule on a column wins.

    Names are compared without case, so where a frame has columns that differ in case
    only, a rule masks all of them. Spark narrows the rules to this table's columns and
    to one row per column first, so the driver receives at most as many rows as the
    table is wide.
    """
    lowered = {c.lower() for c in columns}
    wanted = (F.lower("database") == database.lower()) & (F.lower("table") == table.lower())
    rows = (
        policies.where(wanted & F.lower("column").isin(sorted(lowered)))
        .groupBy(F.lower("column").alias("name"))
        .agg(F.max_by("masking_option", "line_pos").alias("option"))
        .collect()
    )
    option = {r["name"]: r["option"] for r in rows}
    return {c: option[c.lower()] for c in columns if c.lower() in option}


def apply_mask_options(df: DataFrame, options: dict[str, str]) -> DataFrame:
    """One projection: masked columns replaced, the others passed through."""
    return df.select(
        *[
            mask(F.col(_quoted(f.name)), f.dataType, options[f.name]).alias(f.name)
            if f.name in options
            else F.col(_quoted(f.name))
            for f in df.schema.fields
        ]
    )


def apply_masks(df: DataFrame, database: str, table: str, policies: DataFrame) -> DataFrame:
    """What a reader of database.table may see under `policies`.

    Apply it before any filter of the reader, so that filters on masked columns
    test the masked values; filters on other columns still reach the scan.
    """
    return apply_mask_options(df, chosen_masks(policies, database, table, df.columns))
