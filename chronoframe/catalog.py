"""Every registered query with the SQL that gives the same rows."""

from __future__ import annotations

import importlib
import pkgutil

from pyspark.sql import DataFrame, SparkSession

from chronoframe import queries
from chronoframe.queries.registry import ORACLE_SQL, QUERIES

for _module in pkgutil.iter_modules(queries.__path__):
    importlib.import_module(f"chronoframe.queries.{_module.name}")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES["breadth_daily"](spark, folder)


__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
