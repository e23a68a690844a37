"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Registers a plan, and the SQL that must give the same rows."""

    def add(plan: Plan) -> Plan:
        QUERIES[name] = plan
        if sql:
            ORACLES[name] = sql
        return plan

    return add
