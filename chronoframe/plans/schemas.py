"""Declared schemas and keys, with a check of what a table really has."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string


@dataclass(frozen=True)
class Declared:
    """A table's columns in DDL and its key."""

    ddl: str
    key: tuple[str, ...]

    def schema(self) -> StructType:
        return _parse_datatype_string(self.ddl)


REGISTRY = {
    "prices": Declared("entity string, board string, d date, open double, high double, low double, close double, volume double, value double", ("entity", "board", "d")),
    "segments": Declared("entity string, board string, valid_from date, valid_to date, priority int", ("entity", "board", "valid_from")),
    "dividends": Declared("entity string, d date, dividend double, currency string, declared date, paid date", ("entity", "d")),
    "returns": Declared("entity string, d date, price_return double, log_return double, dividend_return double, total_return double, total_return_index double, calculation_version string", ("entity", "d", "calculation_version")),
    "observations": Declared("series string, observed date, available timestamp, vintage long, value double", ("series", "observed", "vintage")),
    "forecasts": Declared("forecast_id string, entity string, cutoff date, horizon int, value double, policy_hash string", ("forecast_id",)),
    "runs": Declared("run_id string, status string, received long, inserted long, at timestamp", ("run_id", "at")),
}


def drift(df: DataFrame, name: str) -> list[str]:
    """What differs from the declaration: missing columns, other types, columns not declared."""
    want, have = {f.name: f.dataType.simpleString() for f in REGISTRY[name].schema()}, dict(df.dtypes)
    out = [f"missing {c}" for c in want if c not in have]
    out += [f"{c} is {have[c]}, declared {k}" for c, k in want.items() if c in have and have[c] != k]
    return out + [f"undeclared {c}" for c in have if c not in want]


def conform(df: DataFrame, name: str) -> DataFrame:
    """df in the declared order and types; additive columns that are missing come as nulls."""
    from pyspark.sql import functions as F

    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in REGISTRY[name].schema()])
