"""Masks and masking rules."""

from __future__ import annotations

import posixpath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import given, query
from parchmill.functions import masks
from parchmill.operators.masking import apply_masks
from parchmill.operators.masked_views import create_masked_view
from parchmill.operators.policies import (
    apply_upsert,
    desired_policies,
    has_field,
    lookup_policy,
    parse_policies,
    policy_document,
    policy_name,
    policy_outcomes,
    policy_rejects,
    policy_store_after,
    policy_upsert_plan,
    store_as_of,
    stored_rules,
)
from parchmill.plans.masking_policies import apply_rule_list
from parchmill.session import scratch_path

# --- masks on tables ---------------------------------------------------------


def _rules(spark: SparkSession, *lines: str) -> DataFrame:
    table = pa.table({"line_pos": list(range(len(lines))), "line": list(lines)})
    return parse_policies(spark.createDataFrame(table))


def _redacted(column: str) -> str:
    out = column
    for letters, sign in ((r"\p{Lu}", "X"), (r"\p{Ll}", "x"), (r"\p{Nd}", "n")):
        out = f"regexp_replace({out}, '{letters}', '{sign}', 'g')"
    return out


def _last_4(column: str) -> str:
    head = f"left({column}, greatest(length({column}) - 4, 0))"
    for letters in (r"\p{Lu}", r"\p{Ll}", r"\p{Nd}"):
        head = f"regexp_replace({head}, '{letters}', 'x', 'g')"
    return f"{head} || right({column}, 4)"


def _ones(column: str, data_type: str) -> str:
    return f"CAST(regexp_replace(CAST({column} AS VARCHAR), '[0-9]', '1', 'g') AS {data_type})"


@query(
    f"""SELECT c_custkey, {_redacted("c_name")} AS c_name, c_nationkey,
               CAST(NULL AS DOUBLE) AS c_acctbal, sha256(c_mktsegment) AS c_mktsegment
        FROM customer"""
)
def masked_customer(spark: SparkSession, sf: str) -> DataFrame:
    rules = _rules(
        spark,
        "# rules of the customer table",
        "shop,customer,c_name,MASK_NULL",
        "shop, customer, c_name, MASK",
        "shop,customer,c_mktsegment,MASK_HASH",
        "shop,customer,c_acctbal,MASK_NULL",
        "shop,orders,c_nationkey,MASK_NULL",
    )
    return apply_masks(given(spark, sf, "customer"), "shop", "customer", rules)


@query(
    f"""SELECT o_orderkey, {_ones("o_custkey", "BIGINT")} AS o_custkey, o_orderstatus,
               CAST(NULL AS DOUBLE) AS o_totalprice, o_orderdate,
               {_last_4("o_orderpriority")} AS o_orderpriority
        FROM orders"""
)
def masked_orders(spark: SparkSession, sf: str) -> DataFrame:
    rules = _rules(
        spark,
        "shop,orders,o_orderpriority,MASK_SHOW_LAST_4",
        "shop,orders,o_totalprice,MASK_NULL",
        "shop,orders,o_custkey,MASK",
    )
    return apply_masks(given(spark, sf, "orders"), "shop", "orders", rules)


def _masked_view(spark: SparkSession, sf: str, name: str, **exempt: list[str]) -> DataFrame:
    """What SQL readers of a view of the orders see."""
    place = scratch_path(spark, "database")
    database = "views_" + posixpath.basename(place).rpartition("-")[2]
    spark.sql(f"CREATE DATABASE {database} LOCATION '{place}'")
    spark.sql(f"CREATE TABLE {database}.orders USING parquet LOCATION '{sf}/orders.parquet'")
    rules = _rules(
        spark,
        f"{database},orders,o_orderpriority,MASK_SHOW_LAST_4",
        f"{database},orders,o_totalprice,MASK_NULL",
        f"{database},orders,o_custkey,MASK",
    )
    create_masked_view(spark, database, "orders", name, rules, **exempt)
    return spark.sql(f"SELECT * FROM {database}.{name} WHERE o_orderkey > 10")


@query(
    f"""SELECT o_orderkey, {_ones("o_custkey", "BIGINT")} AS o_custkey, o_orderstatus,
               CAST(NULL AS DOUBLE) AS o_totalprice, o_orderdate,
               {_last_4("o_orderpriority")} AS o_orderpriority
        FROM orders WHERE o_orderkey > 10"""
)
def masked_view_public(spark: SparkSession, sf: str) -> DataFrame:
    return _masked_view(spark, sf, "orders_seen", exempt_users=["somebody else"])


@query("SELECT * FROM orders WHERE o_orderkey > 10")
def masked_view_exempt(spark: SparkSession, sf: str) -> DataFrame:
    me = spark.sql("SELECT current_user()").first()[0]
    return _masked_view(spark, sf, "orders_seen", exempt_users=[me])


def _masked(df: DataFrame, key: str, option: str) -> DataFrame:
    return df.select(
        key,
        *[
            masks.mask(F.col(f.name), f.dataType, option).alias(f.name)
            for f in df.schema.fields
            if f.name != key
        ],
    )


@query(
    f"""SELECT p_partkey, {_redacted("p_name")} AS p_name, {_redacted("p_type")} AS p_type,
               {_ones("p_size", "INTEGER")} AS p_size, CAST(NULL AS DOUBLE) AS p_retailprice
        FROM part"""
)
def mask_redact(spark: SparkSession, sf: str) -> DataFrame:
    part = given(spark, sf, "part").drop("p_brand")
    return _masked(part, "p_partkey", "MASK")


_NUMBER = "CAST(s_suppkey * 100003 AS VARCHAR)"


@query(
    f"""SELECT s_suppkey, {_last_4("s_name")} AS s_name,
               CAST({_last_4(_NUMBER).replace("'x'", "'1'")} AS BIGINT) AS number,
               CAST(NULL AS DOUBLE) AS s_acctbal
        FROM supplier"""
)
def mask_show_last_4(spark: SparkSession, sf: str) -> DataFrame:
    supplier = given(spark, sf, "supplier").select(
        "s_suppkey", "s_name", (F.col("s_suppkey") * 100003).alias("number"), "s_acctbal"
    )
    return _masked(supplier, "s_suppkey", "MASK_SHOW_LAST_4")


@query(
    """SELECT p_partkey, sha256(p_name) AS p_name, sha256(p_type) AS p_type,
              CAST(NULL AS INTEGER) AS p_size
       FROM part"""
)
def mask_hash(spark: SparkSession, sf: str) -> DataFrame:
    part = given(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size")
    return _masked(part, "p_partkey", "MASK_HASH")


@query(
    """SELECT p_partkey, CAST(NULL AS VARCHAR) AS p_name, CAST(NULL AS DOUBLE) AS p_retailprice
       FROM part"""
)
def mask_null(spark: SparkSession, sf: str) -> DataFrame:
    part = given(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    return _masked(part, "p_partkey", "MASK_NULL")


# --- rule lists: one line per customer ---------------------------------------

_LINES = """lines AS (
  SELECT k AS line_pos, CASE k % 10
    WHEN 0 THEN '  # ' || c_name
    WHEN 1 THEN ' ' || chr(9) || ' '
    WHEN 2 THEN 'db,' || c_mktsegment || ',col'
    WHEN 3 THEN 'db,t,col,MASK,' || c_name
    WHEN 8 THEN 'amb,x-seg' || CAST(d % 5 AS VARCHAR) || ',c' || CAST(d AS VARCHAR) || ',MASK'
    WHEN 9 THEN 'amb-x,seg' || CAST(d % 5 AS VARCHAR) || ',c' || CAST(d AS VARCHAR) || ',MASK_HASH'
    ELSE ' db' || CAST(c_nationkey AS VARCHAR) || ' , ' || c_mktsegment || ',col'
      || CAST(d % 7 AS VARCHAR) || ' ,' || chr(9)
      || CASE k % 4 WHEN 0 THEN 'MASK' WHEN 1 THEN 'MASK_HASH' WHEN 2 THEN 'MASK_NULL'
         ELSE 'MASK_SHOW_LAST_4' END
    END AS line
  FROM (SELECT *, c_custkey AS k, CAST(floor(c_custkey / 10) AS BIGINT) AS d FROM customer) c)"""

_WS = "' ' || chr(9)"
_STRIPPED = f"""{_LINES}, rule_lines AS (
  SELECT line_pos, trim(line, {_WS}) AS line FROM lines
  WHERE trim(line, {_WS}) <> '' AND NOT starts_with(trim(line, {_WS}), '#'))"""
_RULES = f"""{_STRIPPED}, rules AS (
  SELECT line_pos, trim(p[1], {_WS}) AS "database", trim(p[2], {_WS}) AS "table",
         trim(p[3], {_WS}) AS "column", trim(p[4], {_WS}) AS masking_option
  FROM (SELECT line_pos, string_split(line, ',') AS p FROM rule_lines) WHERE len(p) = 4)"""
_NAME = """'masking-' || "database" || '-' || "table" || '-' || "column\""""
_DOCUMENT = f"""CAST(to_json({{
  'service': 'warehouse', 'name': {_NAME}, 'policyType': 0,
  'description': 'Column masking for ' || "database" || '.' || "table" || '.' || "column",
  'isAuditEnabled': true,
  'resources': {{
    'database': {{'values': ["database"], 'isExcludes': false, 'isRecursive': false}},
    'table': {{'values': ["table"], 'isExcludes': false, 'isRecursive': false}},
    'column': {{'values': ["column"], 'isExcludes': false, 'isRecursive': false}}}},
  'policyItems': CAST([] AS VARCHAR[]), 'denyPolicyItems': CAST([] AS VARCHAR[]),
  'allowExceptions': CAST([] AS VARCHAR[]), 'denyExceptions': CAST([] AS VARCHAR[]),
  'dataMaskPolicyItems': [{{
    'dataMaskInfo': {{'dataMaskType': masking_option, 'conditionExpr': '', 'valueExpr': ''}},
    'accesses': [{{'type': 'select', 'isAllowed': true}}],
    'users': CAST([] AS VARCHAR[]), 'groups': ['public'], 'roles': CAST([] AS VARCHAR[]),
    'conditions': CAST([] AS VARCHAR[])}}],
  'serviceType': 'hive', 'options': MAP {{}}, 'validitySchedules': CAST([] AS VARCHAR[]),
  'policyLabels': CAST([] AS VARCHAR[]), 'zoneName': '', 'isDenyAllElse': true}}) AS VARCHAR)"""
_DESIRED = f"""{_RULES}, documents_of AS (
  SELECT *, {_NAME} AS name, {_DOCUMENT} AS document FROM rules
), desired AS (
  SELECT name, arg_max("database", line_pos) AS "database", arg_max("table", line_pos) AS "table",
         arg_max("column", line_pos) AS "column",
         arg_max(masking_option, line_pos) AS masking_option,
         count(*) AS n_lines,
         count(DISTINCT "database" || chr(0) || "table" || chr(0) || "column") > 1 AS ambiguous,
         arg_max(document, line_pos) AS document
  FROM documents_of GROUP BY name
), store AS (
  SELECT min(line_pos) AS id, {_NAME} AS name, '{{"version":0}}' AS document
  FROM rules WHERE masking_option IN ('MASK', 'MASK_NULL') GROUP BY 2
), plan AS (
  SELECT d.*, s.id, CASE WHEN s.id IS NULL THEN 'create' ELSE 'update' END AS action
  FROM desired d LEFT JOIN store s ON d.name = s.name)"""


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    given(spark, sf, "customer").createOrReplaceTempView("customer")
    return spark.sql(f"WITH {_LINES} SELECT line_pos, line FROM lines".replace("VARCHAR", "STRING"))


def _policies(spark: SparkSession, sf: str) -> DataFrame:
    return parse_policies(_lines(spark, sf), on_error="skip")


def _name() -> F.Column:
    return policy_name(F.col("database"), F.col("table"), F.col("column"))


def _store(spark: SparkSession, sf: str) -> DataFrame:
    return (
        _policies(spark, sf)
        .where("masking_option in ('MASK', 'MASK_NULL')")
        .groupBy(_name().alias("name"))
        .agg(F.min("line_pos").alias("id"))
        .select("id", "name", F.lit('{"version":0}').alias("document"))
    )


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    # Rules that null a column are wanted no more, so the store keeps some as they are.
    policies = _policies(spark, sf).where("masking_option <> 'MASK_NULL'")
    return policy_upsert_plan(desired_policies(policies, "warehouse"), _store(spark, sf))


_WANTED = _DESIRED.replace("FROM rules\n)", "FROM rules WHERE masking_option <> 'MASK_NULL'\n)")


@query(f"WITH {_RULES} SELECT * FROM rules", name="parse_policies")
def parse_policies_skip(spark: SparkSession, sf: str) -> DataFrame:
    return _policies(spark, sf)


@query(
    f"""WITH {_RULES} SELECT line_pos, "database", "table", "column", masking_option FROM rules"""
)
def parse_policies_strict(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat_ws(" , ", "database", "table", "column", "masking_option")
    written = _policies(spark, sf).select("line_pos", line.alias("line"))
    return parse_policies(written, on_error="fail")


@query(
    f"""WITH {_STRIPPED} SELECT line_pos, line, len(string_split(line, ',')) AS n_fields
        FROM rule_lines WHERE len(string_split(line, ',')) <> 4""",
    name="policy_rejects",
)
def policy_reject_lines(spark: SparkSession, sf: str) -> DataFrame:
    rejects = policy_rejects(_lines(spark, sf))
    return rejects.withColumn("n_fields", F.col("n_fields").cast("bigint"))


@query(f"WITH {_RULES} SELECT line_pos, {_NAME} AS name FROM rules", name="policy_name")
def policy_names(spark: SparkSession, sf: str) -> DataFrame:
    return _policies(spark, sf).select("line_pos", _name().alias("name"))


@query(f"WITH {_RULES} SELECT line_pos, {_DOCUMENT} AS document FROM rules", name="policy_document")
def policy_documents(spark: SparkSession, sf: str) -> DataFrame:
    parts = [F.col(c) for c in ("database", "table", "column", "masking_option")]
    document = policy_document(*parts, service="warehouse")
    return _policies(spark, sf).select("line_pos", document.alias("document"))


@query(
    f"""WITH {_DESIRED} SELECT id, name, document FROM store
        WHERE name = 'masking-amb-x-seg0-c0'""",
    name="lookup_policy",
)
def lookup_stored_policy(spark: SparkSession, sf: str) -> DataFrame:
    return lookup_policy(_store(spark, sf), "masking-amb-x-seg0-c0")


@query(f"WITH {_WANTED} SELECT * FROM plan", name="policy_upsert_plan")
def policy_plan(spark: SparkSession, sf: str) -> DataFrame:
    return _plan(spark, sf)


_AFTER = f"""{_WANTED}, after AS (
  SELECT s.id, s.name, coalesce(p.document, s.document) AS document
  FROM store s LEFT JOIN plan p ON s.name = p.name
  UNION ALL
  SELECT (SELECT max(id) FROM store)
           + row_number() OVER (ORDER BY left(sha256(name), 3), name) AS id, name, document
  FROM plan WHERE action = 'create')"""


def _wanted(spark: SparkSession, sf: str) -> DataFrame:
    policies = _policies(spark, sf).where("masking_option <> 'MASK_NULL'")
    return desired_policies(policies, "warehouse")


@query(f"WITH {_AFTER} SELECT * FROM after", name="policy_store_after")
def policy_store_next(spark: SparkSession, sf: str) -> DataFrame:
    return policy_store_after(_wanted(spark, sf), _store(spark, sf))


@query(
    f"""WITH {_AFTER} SELECT p.name, p.action, a.id
        FROM plan p JOIN after a ON p.name = a.name""",
    name="policy_outcomes",
)
def policy_upsert_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return policy_outcomes(_wanted(spark, sf), _store(spark, sf))


@query(
    f"""WITH {_DESIRED} SELECT id, name, 'warehouse' AS service, 0 AS policy_type, "database",
          "table", "column", masking_option, true AS has_mask, false AS has_other
        FROM (SELECT *, row_number() OVER (ORDER BY left(sha256(name), 3), name) AS id FROM desired)"""
)
def stored_policy_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written to a store and read back by field."""
    empty = spark.createDataFrame([], "id bigint, name string, document string")
    store = policy_store_after(desired_policies(_policies(spark, sf), "warehouse"), empty)
    document = F.col("document")
    marked = store.select(
        F.col("id").alias("_id"),
        has_field(document, "resources", "column").alias("has_mask"),
        has_field(document, "resources", "schema").alias("has_other"),
    )
    return stored_rules(store).join(marked, F.col("id") == F.col("_id")).drop("_id")


def _rule_job(spark: SparkSession, sf: str) -> tuple[str, str]:
    """A list in a file, in its order, and a database for its store."""
    path = scratch_path(spark, "rules")
    _lines(spark, sf).orderBy("line_pos").select("line").write.text(path)
    database = "policies_" + posixpath.basename(path).rpartition("-")[2]
    place = scratch_path(spark, "database")
    spark.sql(f"CREATE DATABASE {database} LOCATION '{place}'")
    return path, database


@query(
    f"""WITH {_DESIRED} SELECT name, 'create' AS action,
          row_number() OVER (ORDER BY left(sha256(name), 3), name) AS id, true AS succeeded
        FROM desired"""
)
def rule_list_job(spark: SparkSession, sf: str) -> DataFrame:
    """A list to a policy store that is new."""
    path, database = _rule_job(spark, sf)
    return apply_rule_list(spark, path, database, "store", "warehouse", on_error="skip")


@query(
    f"""WITH {_DESIRED} SELECT d.name, CASE WHEN s.id IS NULL THEN 'create' ELSE 'update' END AS action,
          coalesce(s.id, (SELECT max(id) FROM store) + row_number() OVER (
            PARTITION BY s.id IS NULL ORDER BY left(sha256(d.name), 3), d.name)) AS id, true AS succeeded
        FROM desired d LEFT JOIN store s ON d.name = s.name"""
)
def rule_list_job_on_a_store(spark: SparkSession, sf: str) -> DataFrame:
    """The same list to a store that holds some of its policies: updates and creates."""
    path, database = _rule_job(spark, sf)
    place = scratch_path(spark, "store")
    _store(spark, sf).write.parquet(place)
    spark.sql(
        f"CREATE TABLE {database}.store (id BIGINT, name STRING, document STRING) "
        f"USING parquet LOCATION '{place}'"
    )
    return apply_rule_list(spark, path, database, "store", "warehouse", on_error="skip")


@query(
    f"""WITH {_DESIRED} SELECT row_number() OVER (ORDER BY left(sha256(name), 3), name) AS id, name, document
        FROM desired"""
)
def policy_store_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """A store's first version, after a second list has changed most of its policies."""
    path, database = _rule_job(spark, sf)
    apply_rule_list(spark, path, database, "store", "warehouse", on_error="skip")
    apply_upsert(spark, database, "store", desired_policies(_policies(spark, sf).where("masking_option <> 'MASK_NULL'"), "other"))
    return store_as_of(spark, database, "store", 1)
