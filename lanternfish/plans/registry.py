"""All queries of the core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lanternfish.plans import audit, audit_sql, data_problems, data_problems_sql

Query = Callable[[SparkSession, str], DataFrame]
PROBLEMS = [
    "p1_found", "p1_failed_casts", "p1_records", "p3_found", "p4_found", "p4_nodes", "p4_findings", "p4_leaves", "p4_risks",
    "p4_insights", "p4_evidence", "p4_unresolved", "p4_overreach", "p4_scopes", "p4_tags", "p4_risk_capabilities",
]


def queries() -> dict[str, Query]:
    """Name to function(spark, folder)."""
    return {n: getattr(data_problems, n) for n in PROBLEMS} | {n: getattr(audit, n) for n in audit.NAMES}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL over views named like the tables."""
    return data_problems_sql.SQL | audit_sql.SQL
