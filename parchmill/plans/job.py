"""Run one of the named table jobs from a configuration."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from parchmill.sinks.tables import load_table
from parchmill.sources.delimited import scan_csv, scan_csv_raw
from parchmill.sources.excel import scan_excel
from parchmill.sources.tables import scan_jdbc, scan_table

Config = Mapping[str, Mapping[str, str]]


def _catalog(spark: SparkSession, conf: Config) -> DataFrame:
    return scan_table(spark, conf["hive"]["database"], conf["hive"]["table"])


def _jdbc(spark: SparkSession, conf: Config) -> DataFrame:
    c = conf["impala"]
    url = c.get("url") or f"jdbc:impala://{c['host']}:{int(c['port'])}/{c['database']}"
    split = {
        k: c.get(k) for k in ("partition_column", "lower_bound", "upper_bound", "num_partitions")
    }
    # What is left of the section goes to the driver: user, password, auth_mechanism, ...
    known = {"url", "host", "port", "database", "table", "driver", "one_task", "quote", *split}
    return scan_jdbc(
        spark,
        url,
        c["database"],
        c["table"],
        driver=c.get("driver"),
        one_task=c.get("one_task", "").lower() == "true",
        quote=c.get("quote", "`"),
        properties={k: v for k, v in c.items() if k not in known},
        **split,
    )


def _load_csv(spark: SparkSession, conf: Config) -> DataFrame:
    df = scan_csv(spark, conf["local_files"]["input_csv"])
    hive = conf["hive"]
    load_table(df, hive["database"], hive["table"], path=hive.get("location"))
    return _catalog(spark, conf)


# The method names a configuration may give.
METHODS: dict[str, Callable[[SparkSession, Config], DataFrame]] = {
    "read_hive_spark": _catalog,
    "read_hive_hwc": _catalog,
    "read_impala": _jdbc,
    "load_local_to_hive": _load_csv,
    "read_hdfs_pydoop": lambda spark, conf: scan_csv_raw(spark, conf["hdfs"]["input_csv"]),
    "read_local_excel": lambda spark, conf: scan_excel(spark, conf["local_files"]["input_excel"]),
    "read_hdfs_excel": lambda spark, conf: scan_excel(spark, conf["hdfs"]["input_excel"]),
}


def run_job(spark: SparkSession, conf: Config) -> DataFrame:
    """The result of the method that conf["processing"]["method"] names.

    `conf` is a mapping of sections to mappings, such as a read ConfigParser.
    Print the result with `.show()`.
    """
    method = conf["processing"]["method"]
    if method not in METHODS:
        raise ValueError(f"no method {method!r}; known: {', '.join(METHODS)}")
    return METHODS[method](spark, conf)
