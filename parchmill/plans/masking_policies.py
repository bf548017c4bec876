"""The masking job: a rule list to the policy store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parchmill.operators.policies import apply_upsert, desired_policies, parse_policies
from parchmill.sources.lines import scan_policy_lines


def apply_rule_list(
    spark: SparkSession,
    path: str,
    database: str,
    table: str,
    service: str,
    on_error: str = "fail",
    policy_type: int = 0,
) -> DataFrame:
    """Create or update the policies of a rule list in the store table
    database.table; returns (name, action, id, succeeded)."""
    rules = parse_policies(scan_policy_lines(spark, path), on_error)
    return apply_upsert(spark, database, table, desired_policies(rules, service, policy_type))
