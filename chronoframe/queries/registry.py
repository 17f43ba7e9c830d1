"""Registration of queries and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoframe.plans.bindings import SQL_VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def oracle(sql: str) -> str:
    """The text with the views it names put before it."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name, body in SQL_VIEWS.items():
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text, re.I):
                add(body)
                needed.append(name)

    add(sql)
    if not needed:
        return sql
    views = ",\n".join(f"{name} AS MATERIALIZED ({SQL_VIEWS[name]})" for name in needed)
    rest = re.sub(r"^\s*WITH\s+", ",\n", sql, count=1, flags=re.I) if re.match(r"\s*WITH\s", sql, re.I) else "\n" + sql
    recursive = "RECURSIVE " if re.search(r"\bRECURSIVE\b", sql) else ""
    return f"WITH {recursive}{views}{rest.replace('RECURSIVE ', '', 1) if recursive else rest}"


def query(sql: str | None = None):
    """Register f(Tables) -> DataFrame under its name, with its SQL if there is any."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLE_SQL[f.__name__] = oracle(sql)
        return f

    return add
