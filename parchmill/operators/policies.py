"""Masking rules as tables: parse, name, document, plan and apply an upsert."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchmill.functions.text import split_fields, strip
from parchmill.operators.numbering import number_by_key
from parchmill.session import scratch_path
from parchmill.sources.tables import table_name

FIELDS = ("database", "table", "column", "masking_option")


class InvalidPolicyLine(ValueError):
    """A rule line does not have exactly four comma-separated fields."""


def _rule_lines(lines: DataFrame) -> DataFrame:
    """(line_pos, line, parts) of the lines that are neither blank nor comments."""
    line = strip(F.col("line"))
    return (
        lines.select("line_pos", line.alias("line"))
        .where((F.col("line") != "") & ~F.col("line").startswith("#"))
        .withColumn("parts", split_fields(F.col("line"), ","))
    )


def policy_rejects(lines: DataFrame) -> DataFrame:
    """Rule lines with a wrong number of fields."""
    rules = _rule_lines(lines)
    return rules.where(F.size("parts") != len(FIELDS)).select(
        "line_pos", "line", F.size("parts").alias("n_fields")
    )


def parse_policies(lines: DataFrame, on_error: str = "fail") -> DataFrame:
    """(line_pos, database, table, column, masking_option) of a rule list.

    `on_error="fail"` refuses the whole list if one line is malformed, as soon
    as this function is called; `"skip"` leaves such lines out.
    """
    if on_error not in ("fail", "skip"):
        raise ValueError("on_error must be 'fail' or 'skip'")
    if on_error == "fail":
        bad = policy_rejects(lines).head(1)
        if bad:
            raise InvalidPolicyLine(f"expected {len(FIELDS)} fields in line: {bad[0]['line']}")
    rules = _rule_lines(lines).where(F.size("parts") == len(FIELDS))
    return rules.select(
        "line_pos", *[strip(F.col("parts")[i]).alias(f) for i, f in enumerate(FIELDS)]
    )


def policy_name(database: Column, table: Column, column: Column) -> Column:
    """masking-{database}-{table}-{column}; null if a part is null."""
    return F.concat(F.lit("masking-"), database, F.lit("-"), table, F.lit("-"), column)


def _resource(value: Column) -> Column:
    return F.struct(
        F.array(value).alias("values"),
        F.lit(False).alias("isExcludes"),
        F.lit(False).alias("isRecursive"),
    )


def policy_document(
    database: Column,
    table: Column,
    column: Column,
    masking_option: Column,
    service: str,
    policy_type: int = 0,
) -> Column:
    """The policy as a JSON document."""
    none = F.array().cast("array<string>")
    mask_item = F.struct(
        F.struct(
            masking_option.alias("dataMaskType"),
            F.lit("").alias("conditionExpr"),
            F.lit("").alias("valueExpr"),
        ).alias("dataMaskInfo"),
        F.array(F.struct(F.lit("select").alias("type"), F.lit(True).alias("isAllowed"))).alias(
            "accesses"
        ),
        none.alias("users"),
        F.array(F.lit("public")).alias("groups"),
        none.alias("roles"),
        none.alias("conditions"),
    )
    # Field names, their order and the constants of the format.
    return F.to_json(
        F.struct(
            F.lit(service).alias("service"),
            policy_name(database, table, column).alias("name"),
            F.lit(policy_type).alias("policyType"),
            F.concat(
                F.lit("Column masking for "), database, F.lit("."), table, F.lit("."), column
            ).alias("description"),
            F.lit(True).alias("isAuditEnabled"),
            F.struct(
                _resource(database).alias("database"),
                _resource(table).alias("table"),
                _resource(column).alias("column"),
            ).alias("resources"),
            none.alias("policyItems"),
            none.alias("denyPolicyItems"),
            none.alias("allowExceptions"),
            none.alias("denyExceptions"),
            F.array(mask_item).alias("dataMaskPolicyItems"),
            F.lit("hive").alias("serviceType"),
            F.create_map().cast("map<string,string>").alias("options"),
            none.alias("validitySchedules"),
            none.alias("policyLabels"),
            F.lit("").alias("zoneName"),
            F.lit(True).alias("isDenyAllElse"),
        )
    )


def desired_policies(policies: DataFrame, service: str, policy_type: int = 0) -> DataFrame:
    """One row per policy name: the last rule of that name and its document.

    `ambiguous` marks names that stand for more than one resource, which can
    happen because the name joins its parts with a sign the parts may contain.
    The aggregates combine before the shuffle, so copies of a rule cost nothing.
    """
    cols = [F.col(f) for f in FIELDS]
    resource = F.struct(*cols[:3])
    last = (
        policies.groupBy(policy_name(*cols[:3]).alias("name"))
        .agg(
            F.max(F.struct("line_pos", *FIELDS)).alias("last"),
            F.count("*").alias("n_lines"),
            (F.min(resource) != F.max(resource)).alias("ambiguous"),
        )
        .select("name", *[F.col(f"last.{f}").alias(f) for f in FIELDS], "n_lines", "ambiguous")
    )
    return last.withColumn("document", policy_document(*cols, service, policy_type))


def lookup_policy(store: DataFrame, name: str) -> DataFrame:
    """Stored policies with exactly this name."""
    return store.where(F.col("name") == name)


def policy_upsert_plan(desired: DataFrame, store: DataFrame) -> DataFrame:
    """`desired` with `id` and `action`: update where the name is stored, else create."""
    stored = store.groupBy("name").agg(F.min("id").alias("id"))
    return desired.join(stored, "name", "left").withColumn(
        "action", F.when(F.col("id").isNotNull(), "update").otherwise("create")
    )


def merge_policies(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """(id, name, document, action) of the store once `wanted` (name, document) is
    carried out: action is update, create or keep.

    A name that is stored several times is updated where its id is smallest. Both sides
    are read once: they are joined, the result is written to the shared folder, and new
    ids, from the highest on, are counted on what was written.
    """
    spark = wanted.sparkSession
    new = wanted.select(F.col("name").alias("_name"), F.col("document").alias("_wanted"))
    both = store.select("id", "name", "document").join(new, F.col("name") == F.col("_name"), "full")
    both = both.withColumn("name", F.coalesce("name", "_name"))
    turn = F.row_number().over(Window.partitionBy("name").orderBy("id"))
    action = (
        F.when(F.col("_name").isNull() | (turn > 1), "keep")
        .when(F.col("id").isNull(), "create")
        .otherwise("update")
    )
    both = both.withColumn("action", action)
    document = F.when(F.col("action") == "keep", F.col("document")).otherwise(F.col("_wanted"))
    path = scratch_path(spark, "policies")
    both.select("id", "name", document.alias("document"), "action").write.parquet(path)
    merged = spark.read.parquet(path)

    highest = merged.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id")).scalar()
    created = number_by_key(merged.where(F.col("action") == "create").drop("id"), "name", "n")
    created = created.select((highest + F.col("n")).alias("id"), "name", "document", "action")
    return merged.where(F.col("action") != "create").unionByName(created)


def policy_store_after(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """(id, name, document) of the store once `wanted` is carried out."""
    return merge_policies(wanted, store).select("id", "name", "document")


def policy_outcomes(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """What happens to each wanted policy: (name, action, id)."""
    merged = merge_policies(wanted, store)
    return merged.where(F.col("action") != "keep").select("name", "action", "id")


def _version_table(table: str, version: int) -> str:
    return f"{table}__v{version:010d}"


def store_versions(spark: SparkSession, database: str, table: str) -> list[int]:
    """The numbers of a store's states, from the first on."""
    pattern = re.compile(re.escape(table.lower()) + r"__v(\d{10})")
    tables = spark.catalog.listTables(_bare(database), f"{table}__v*")
    found = (pattern.fullmatch(t.name.lower()) for t in tables)
    return sorted(int(m[1]) for m in found if m)


def store_as_of(spark: SparkSession, database: str, table: str, version: int) -> DataFrame:
    """(id, name, document) of the store as one of its versions left it; version 0 is the
    store before its first."""
    if version == 0:
        return spark.createDataFrame([], _STORE)
    return spark.table(table_name(database, _version_table(table, version)))


def _bare(database: str) -> str:
    return "`" + database.replace("`", "``") + "`"


def _published(spark: SparkSession, database: str, table: str) -> None:
    """Let the store's own name stand for its last version. A job that was slower than
    another finds that one's version afterwards, and sets the name again."""
    name = table_name(database, table)
    shown = 0
    while (last := store_versions(spark, database, table)[-1]) != shown:
        version = table_name(database, _version_table(table, last))
        place = spark.sql(f"DESCRIBE TABLE EXTENDED {version}").where("col_name = 'Location'").first()["data_type"]
        where = place.replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({_STORE}) USING parquet LOCATION '{where}'")
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{where}'")
        spark.catalog.refreshTable(name)
        shown = last


def apply_upsert(
    spark: SparkSession, database: str, table: str, desired: DataFrame
) -> DataFrame:
    """Carry the upsert out on a catalog table and report (name, action, id, succeeded).

    The store's states are versions: tables table__v0000000001 and so on, each with a
    folder of its own. A job merges into the last version it sees and creates the next
    one, which the catalog allows to one job only: one that comes second merges again,
    into what the first has left, so neither loses its updates. Then the store's own name
    gets the last version's location in one change: readers see the old state or the new
    one, and a job that fails on the way changes nothing. A store that had no versions has
    its state kept as the first. Old versions stay for store_as_of() and for those that
    still read them, until drop_versions(). A policy succeeded if the version holds
    exactly its document.
    """
    name = table_name(database, table)
    folder = spark.catalog.getDatabase(_bare(database)).locationUri.rstrip("/")
    while True:
        versions = store_versions(spark, database, table)
        if not versions and spark.catalog.tableExists(name):
            _created(spark, database, table, 1, folder, spark.table(name).select("id", "name", "document"))
            continue
        last = versions[-1] if versions else 0
        merged = scratch_path(spark, "upsert")
        merge_policies(desired, store_as_of(spark, database, table, last)).write.parquet(merged)
        made = spark.read.parquet(merged)
        if _created(spark, database, table, last + 1, folder, made.select("id", "name", "document")):
            break
    _published(spark, database, table)
    held = store_as_of(spark, database, table, last + 1)
    held = held.select(F.col("id").alias("_id"), F.col("name").alias("_n"), F.col("document").alias("_d"))
    changed = made.where(F.col("action") != "keep")
    both = changed.join(held, F.col("id") == F.col("_id"), "left")
    same = F.coalesce((F.col("_n") == F.col("name")) & (F.col("_d") == F.col("document")), F.lit(False))
    return both.select("name", "action", "id", same.alias("succeeded"))


def _created(spark: SparkSession, database: str, table: str, version: int, folder: str, state: DataFrame) -> bool:
    """Write a state and make it a version; false if another job has made that one."""
    place = f"{folder}/{table}__{uuid.uuid4().hex}"
    state.write.parquet(place)
    where = place.replace("'", "\\'")
    name = table_name(database, _version_table(table, version))
    try:
        spark.sql(f"CREATE TABLE {name} ({_STORE}) USING parquet LOCATION '{where}'")
    except AnalysisException as e:
        if e.getCondition() != "TABLE_OR_VIEW_ALREADY_EXISTS":
            raise
        return False
    return True


def drop_versions(spark: SparkSession, database: str, table: str, keep: int) -> None:
    """Forget all versions but the last `keep` (one at least). Their folders stay for the
    storage's own cleaning."""
    for version in store_versions(spark, database, table)[: -max(keep, 1)]:
        spark.sql(f"DROP TABLE {table_name(database, _version_table(table, version))}")


_STORE = "id BIGINT, name STRING, document STRING"

# The fields of a stored document that a rule decides.
_STORED = (
    "service string, name string, policyType int, resources struct<database:struct<values:"
    "array<string>>,table:struct<values:array<string>>,column:struct<values:array<string>>>,"
    "dataMaskPolicyItems array<struct<dataMaskInfo:struct<dataMaskType:string>,"
    "users:array<string>,groups:array<string>>>"
)


def stored_rules(store: DataFrame) -> DataFrame:
    """(id, name, service, policy_type, database, table, column, masking_option) read
    back from stored documents; null where a document lacks the field or is none."""
    document = F.from_json("document", _STORED)
    read = store.select("id", F.col("name").alias("stored_name"), document.alias("d"))

    def only(part: str) -> Column:
        return F.get(F.col(f"d.resources.{part}.values"), F.lit(0)).alias(part)

    option = F.get(F.col("d.dataMaskPolicyItems"), F.lit(0))["dataMaskInfo"]["dataMaskType"]
    return read.select(
        "id",
        F.col("stored_name").alias("name"),
        F.col("d.service").alias("service"),
        F.col("d.policyType").alias("policy_type"),
        *[only(p) for p in FIELDS[:3]],
        option.alias("masking_option"),
    )


def stored_items(store: DataFrame) -> DataFrame:
    """(id, name, database, table, column, items) of stored documents: the masks in their
    order, each an option, users and groups."""
    read = store.select("id", "name", F.from_json("document", _STORED).alias("d"))

    def item(i: Column) -> Column:
        return F.struct(
            i["dataMaskInfo"]["dataMaskType"].alias("option"), i["users"].alias("users"), i["groups"].alias("groups")
        )

    return read.select(
        "id",
        "name",
        *[F.get(F.col(f"d.resources.{p}.values"), F.lit(0)).alias(p) for p in FIELDS[:3]],
        F.transform("d.dataMaskPolicyItems", item).alias("items"),
    )


def has_field(document: Column, *names: str) -> Column:
    """Whether a JSON document has a (nested) field, be it null."""
    keys = document
    for parent in names[:-1]:
        keys = F.get_json_object(keys, f"$['{parent}']")
    return F.coalesce(F.array_contains(F.json_object_keys(keys), names[-1]), F.lit(False))
