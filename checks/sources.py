"""Tables, CSV, workbooks, and the text functions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import builders as build
from checks.documents import store_files
from checks.registry import given, prepared, query
from parchmill.functions import text as t
from parchmill.plans.job import run_job
from parchmill.session import scratch_path
from parchmill.sinks.tables import load_table
from parchmill.sources.delimited import raw_rejects, scan_csv, scan_csv_raw
from parchmill.sources.excel import scan_excel
from parchmill.sources.tables import scan_table


def _database(spark: SparkSession, sf: str) -> str:
    name = "parchmill_" + hashlib.sha256(sf.encode()).hexdigest()[:8]
    place = scratch_path(spark, "database")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{place}'")
    return name


@query("SELECT * FROM lineitem")
def scan_catalog(spark: SparkSession, sf: str) -> DataFrame:
    database = _database(spark, sf)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {database}.lineitem USING parquet "
        f"LOCATION '{sf}/lineitem.parquet'"
    )
    # A schema once inferred stays in the catalog, so this is the scan alone.
    return scan_table(spark, database, "lineitem")


def _orders_csv(spark: SparkSession, sf: str) -> str:
    orders = given(spark, sf, "orders").select(
        "o_orderkey",
        F.concat_ws(",", "o_orderstatus", "o_orderpriority").alias("o_both"),
        F.col("o_orderdate").cast("date").alias("o_day"),
        F.when(F.col("o_orderkey") % 5 != 0, F.round("o_totalprice", 2)).alias("o_totalprice"),
        (F.col("o_orderstatus") == "O").alias("o_open"),
    )
    return prepared(spark, sf, "orders-csv", orders.write.option("header", True).csv)


_ORDERS_SQL = """SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey,
  o_orderstatus || ',' || o_orderpriority AS o_both, CAST(o_orderdate AS DATE) AS o_day,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS o_totalprice,
  o_orderstatus = 'O' AS o_open FROM orders"""


@query(_ORDERS_SQL)
def scan_csv_infer(spark: SparkSession, sf: str) -> DataFrame:
    return scan_csv(spark, _orders_csv(spark, sf))


@query(_ORDERS_SQL)
def load_csv_to_table(spark: SparkSession, sf: str) -> DataFrame:
    database = _database(spark, sf)
    spark.sql(f"DROP TABLE IF EXISTS {database}.loaded_orders")
    schema = "o_orderkey int, o_both string, o_day date, o_totalprice double, o_open boolean"
    df = scan_csv(spark, _orders_csv(spark, sf), schema)
    load_table(df, database, "loaded_orders", path=scratch_path(spark, "loaded"))
    return scan_table(spark, database, "loaded_orders")


# Raw lines: short ones, quotes without meaning, blank ones, and data lines that
# read like the header. Every seventh is too long where that is asked for.
_RAW = """raw AS (
  SELECT c_custkey, CASE
    WHEN c_custkey % 13 = 0 THEN 'key,name,segment'
    WHEN c_custkey % 13 = 1 THEN ' '
    WHEN c_custkey % 13 = 2 THEN ' ' || c_name || ',"x" '
    WHEN c_custkey % 13 = 3 THEN c_name || ',,'
    ELSE CAST(c_custkey AS VARCHAR(20)) || ',"' || c_name || '",' || c_mktsegment || '  '
  END || CASE WHEN c_custkey % 7 = 0 AND c_custkey % 13 > 3 THEN ',more' ELSE '' END AS line
  FROM customer)"""
_RAW_FIELDS = f"""{_RAW}, fields AS (
  SELECT c_custkey, line, string_split(trim(line, ' '), ',') AS p FROM raw)"""


def _raw_files(spark: SparkSession, sf: str, too_long: bool) -> str:
    def with_header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"line": ["key,name,segment"]})
        yield from batches

    given(spark, sf, "customer").createOrReplaceTempView("customer")
    line = "line" if too_long else "regexp_replace(line, ',more$', '')"
    lines = spark.sql(f"WITH {_RAW} SELECT {line} AS line FROM raw")
    written = lines.repartition(3).mapInArrow(with_header, "line string").write
    return prepared(spark, sf, f"raw-{too_long}", written.text)


@query(
    f"""WITH {_RAW}, fields AS (
          SELECT string_split(trim(regexp_replace(line, ',more$', ''), ' '), ',') AS p FROM raw)
        SELECT p[1] AS "key", p[2] AS name, p[3] AS segment FROM fields""",
    name="scan_csv_raw",
)
def raw_lines(spark: SparkSession, sf: str) -> DataFrame:
    return scan_csv_raw(spark, _raw_files(spark, sf, too_long=False))


@query(
    f"""WITH {_RAW_FIELDS} SELECT p[1] AS "key", p[2] AS name, p[3] AS segment
        FROM fields WHERE len(p) <= 3"""
)
def scan_csv_raw_reject(spark: SparkSession, sf: str) -> DataFrame:
    return scan_csv_raw(spark, _raw_files(spark, sf, too_long=True), on_long="reject")


@query(
    f"""WITH {_RAW_FIELDS} SELECT line, CAST(len(p) AS INTEGER) AS n_fields
        FROM fields WHERE len(p) > 3"""
)
def csv_raw_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return raw_rejects(spark, _raw_files(spark, sf, too_long=True))


# --- workbooks as tables -----------------------------------------------------

_EXCEL_SQL = """SELECT c_custkey AS "key", CASE WHEN c_custkey % 6 <> 0 THEN c_name END AS name,
  CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS balance, c_acctbal > 0 AS positive,
  c_mktsegment AS "name.1" FROM customer"""


def _workbooks(spark: SparkSession, sf: str) -> str:
    """The customers as workbooks, one per batch of a few hundred."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        missing = ("NA", None)
        header = build.row("key", "name", "balance", "positive", "name")
        for batch in batches:
            rows = batch.to_pylist()
            for at in range(0, len(rows), 400):
                part = rows[at : at + 400]
                body = "".join(
                    build.row(
                        r["c_custkey"],
                        r["c_name"] if r["c_custkey"] % 6 else missing[r["c_custkey"] % 12 > 0],
                        r["c_acctbal"] if r["c_custkey"] % 4 else None,
                        r["c_acctbal"] > 0,
                        r["c_mktsegment"],
                    )
                    for r in part
                )
                book = build.xlsx({"first": header + body, "second": build.row("ignored")})
                name = f"customers-{part[0]['c_custkey']}.xlsx"
                yield pa.RecordBatch.from_pylist([{"path": name, "content": book}])

    files = given(spark, sf, "customer").mapInArrow(pack, "path string, content binary")
    return prepared(spark, sf, "workbooks", lambda root: store_files(files, root))


@query(_EXCEL_SQL, name="scan_excel")
def excel_inferred(spark: SparkSession, sf: str) -> DataFrame:
    return scan_excel(spark, _workbooks(spark, sf))


@query(_EXCEL_SQL)
def scan_excel_schema(spark: SparkSession, sf: str) -> DataFrame:
    schema = "key bigint, name string, balance double, positive boolean, `name.1` string"
    return scan_excel(spark, _workbooks(spark, sf), schema)


# Values of every kind: dates, times that are no dates, errors, texts that read like
# errors, shared strings, a column without a header.
_KINDS_SQL = """SELECT c_custkey AS "key", TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 500 AS INTEGER))
    + to_minutes(CAST(c_custkey % 1440 AS INTEGER)) AS "when", c_name AS shared,
  CASE WHEN c_custkey % 3 = 0 THEN '#REF!' WHEN c_custkey % 3 = 1 THEN 'text' END AS said,
  CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS "Unnamed: 4" FROM customer"""


@query(_KINDS_SQL)
def scan_excel_kinds(spark: SparkSession, sf: str) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for at in range(0, len(rows), 400):
                part = rows[at : at + 400]
                names = [r["c_name"] for r in part]
                body = build.row("key", "when", "shared", "said")
                for k, r in enumerate(part):
                    key = r["c_custkey"]
                    day = 45292 + key % 500 + (key % 1440) / 1440
                    said = "#REF!" if key % 3 == 0 else "text"
                    cells = [build.cell(key), build.cell(day, style=1), build.shared(k)]
                    cells.append(build.cell(said) if key % 3 < 2 else build.error("#REF!"))
                    cells.append(build.cell(None if key % 2 else r["c_acctbal"]))
                    body += "<row>" + "".join(cells) + "</row>"
                styles = '<cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs>'
                book = build.xlsx({"first": body}, build.strings(names), styles)
                yield pa.RecordBatch.from_pylist([{"path": f"k{part[0]['c_custkey']}.xlsx", "content": book}])

    customers = given(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    files = customers.mapInArrow(pack, "path string, content binary")
    return scan_excel(spark, prepared(spark, sf, "kinds", lambda root: store_files(files, root)))


def _job(spark: SparkSession, method: str, **sections: dict) -> DataFrame:
    return run_job(spark, {"processing": {"method": method}, **sections})


@query(_EXCEL_SQL)
def run_named_job(spark: SparkSession, sf: str) -> DataFrame:
    return _job(spark, "read_hdfs_excel", hdfs={"input_excel": _workbooks(spark, sf)})


@query(_EXCEL_SQL)
def run_local_excel_job(spark: SparkSession, sf: str) -> DataFrame:
    return _job(spark, "read_local_excel", local_files={"input_excel": _workbooks(spark, sf)})


def _lineitem(spark: SparkSession, sf: str) -> dict:
    database = _database(spark, sf)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {database}.lineitem USING parquet LOCATION '{sf}/lineitem.parquet'"
    )
    return {"database": database, "table": "lineitem"}


@query("SELECT * FROM lineitem")
def run_catalog_job(spark: SparkSession, sf: str) -> DataFrame:
    return _job(spark, "read_hive_spark", hive=_lineitem(spark, sf))


@query("SELECT * FROM lineitem")
def run_connector_job(spark: SparkSession, sf: str) -> DataFrame:
    return _job(spark, "read_hive_hwc", hive=_lineitem(spark, sf))


@query(_ORDERS_SQL)
def run_load_job(spark: SparkSession, sf: str) -> DataFrame:
    database = _database(spark, sf)
    spark.sql(f"DROP TABLE IF EXISTS {database}.job_orders")
    place = scratch_path(spark, "job-orders")
    files = {"input_csv": _orders_csv(spark, sf)}
    hive = {"database": database, "table": "job_orders", "location": place}
    return _job(spark, "load_local_to_hive", hive=hive, local_files=files)


@query(
    f"""WITH {_RAW}, fields AS (
          SELECT string_split(trim(regexp_replace(line, ',more$', ''), ' '), ',') AS p FROM raw)
        SELECT p[1] AS "key", p[2] AS name, p[3] AS segment FROM fields"""
)
def run_raw_csv_job(spark: SparkSession, sf: str) -> DataFrame:
    return _job(spark, "read_hdfs_pydoop", hdfs={"input_csv": _raw_files(spark, sf, too_long=False)})


# --- text functions ----------------------------------------------------------

_WS = "'" + t.WHITESPACE + "'"


@query(
    rf"""SELECT doc_id, trim(chr(12288) || text || chr(160) || ' ', {_WS}) AS stripped,
          CAST(len(string_split(text, ',')) AS INTEGER) AS n_fields,
          string_split(text, ',')[1] AS first_field,
          lower(lang) AS lowered, starts_with(text, 'The') AS starts, text LIKE '%.' AS ends,
          regexp_replace('d.x/.' || lang || '.tar.' || source, '^.*/', '') AS base_name,
          '.' || lang || '.tar.txt' AS out_name,
          CAST(to_json({{'lang': lang, 'n_chars': n_chars}}) AS VARCHAR) AS packed,
          n_chars > 0 AS truthy
        FROM documents"""
)
def scalar_text_ops(spark: SparkSession, sf: str) -> DataFrame:
    text, lang = F.col("text"), F.col("lang")
    path = F.concat(F.lit("d.x/."), lang, F.lit(".tar."), F.col("source"))
    fields = t.split_fields(text, ",")
    decoded = F.decode(F.encode(text, "UTF-8"), "UTF-8")
    return given(spark, sf, "documents").select(
        "doc_id",
        t.strip(F.concat(F.lit("\u3000"), decoded, F.lit("\xa0 "))).alias("stripped"),
        F.size(fields).alias("n_fields"),
        fields[0].alias("first_field"),
        F.lower(lang).alias("lowered"),
        F.startswith(text, F.lit("The")).alias("starts"),
        F.endswith(text, F.lit(".")).alias("ends"),
        t.base_name(path).alias("base_name"),
        t.out_name(path).alias("out_name"),
        F.to_json(F.struct("lang", "n_chars")).alias("packed"),
        t.truthy(F.col("n_chars"), "bigint").alias("truthy"),
    )
