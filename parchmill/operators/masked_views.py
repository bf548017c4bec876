"""Masks in the catalog: views whose columns test who reads them."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.functions.masks import mask_sql
from parchmill.sources.tables import table_name

# The group that everyone is in, and the option that masks nothing.
EVERYONE, UNMASKED = "public", "MASK_NONE"


class MaskItem(NamedTuple):
    """A mask and whom it is for. Of a column's items the first that fits the reader counts."""

    option: str
    users: tuple[str, ...]
    groups: tuple[str, ...]


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _column(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _fits(item: MaskItem, members: str | None) -> str:
    """Whether the reader is one of those an item is for, as SQL."""
    if EVERYONE in item.groups:
        return "TRUE"
    tests = []
    if item.users:
        tests.append(f"current_user() IN ({', '.join(map(_text, item.users))})")
    if item.groups:
        if members is None:
            raise ValueError(f"groups {', '.join(item.groups)} need a table of members")
        named = ", ".join(map(_text, item.groups))
        tests.append(
            f"(SELECT count(*) > 0 FROM {members} WHERE user_name = current_user() AND group_name IN ({named}))"
        )
    return " OR ".join(tests) or "FALSE"


def mask_items(policies: DataFrame, database: str, table: str) -> dict[str, list[MaskItem]]:
    """Column in lower case -> items, from rules (parse_policies) or from stored policies
    (policies.stored_items). The last rule on a column wins, or of stored policies the one
    with the highest id. The driver gets one row a masked column of the table."""
    wanted = (F.lower("database") == database.lower()) & (F.lower("table") == table.lower())
    if "items" in policies.columns:
        rows = policies.where(wanted).groupBy(F.lower("column").alias("name")).agg(F.max_by("items", "id").alias("items"))
        return {
            r["name"]: [MaskItem(i["option"], tuple(i["users"] or ()), tuple(i["groups"] or ())) for i in r["items"] or ()]
            for r in rows.collect()
        }
    rows = policies.where(wanted).groupBy(F.lower("column").alias("name"))
    rows = rows.agg(F.max_by("masking_option", "line_pos").alias("option"))
    return {r["name"]: [MaskItem(r["option"], (), (EVERYONE,))] for r in rows.collect()}


def create_masked_view(
    spark: SparkSession,
    database: str,
    table: str,
    view: str,
    policies: DataFrame,
    exempt_users: Iterable[str] = (),
    exempt_groups: Iterable[str] = (),
    members: tuple[str, str] | None = None,
) -> None:
    """Create or replace database.view: database.table as its policies let a reader see it.

    A SQL reader of the view gets masks without calling anything. A column's expression
    tests the reader's name (current_user()) and, through the table `members` (a database
    and a table of user_name and group_name), the reader's groups; who is exempt sees the
    values. The name is a constant when a query is planned, so only the expression that
    applies is left in its plan, and filters on columns that are not masked for the reader
    reach the scan. Readers must not be granted the table itself, which is the business of
    the catalog or the storage. A changed policy needs the view to be created again.
    """
    source = table_name(database, table)
    found = mask_items(policies, database, table)
    exempt = MaskItem(UNMASKED, tuple(exempt_users), tuple(exempt_groups))
    where = table_name(*members) if members else None
    columns = []
    for f in spark.table(source).schema.fields:
        name = _column(f.name)
        items = found.get(f.name.lower(), [])
        if exempt.users or exempt.groups:
            items = [exempt, *items] if items else []
        cases = "".join(
            f" WHEN {_fits(i, where)} THEN {name if i.option == UNMASKED else mask_sql(name, f.dataType, i.option)}"
            for i in items
        )
        columns.append(f"CASE{cases} ELSE {name} END AS {name}" if items else name)
    spark.sql(f"CREATE OR REPLACE VIEW {table_name(database, view)} AS SELECT {', '.join(columns)} FROM {source}")
