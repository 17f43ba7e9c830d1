"""Queries whose last digit hangs on how a tie is rounded, row by row and digit by digit against their SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from chronoframe.catalog import ORACLE_SQL, QUERIES
from chronoframe.functions.expr import round_binary

FOLDER = os.environ.get("TEST_ROUNDING_DIR", "/root/testdata/sf0.01")


def test_ties_of_the_shortest_text_are_rounded_by_the_binary_value(spark):
    rows = [(0.5045065, 0.504506), (-0.5045065, -0.504506), (0.1234567, 0.123457), (2.5e-7, 0.0), (1.5, 1.5), (None, None)]
    got = spark.createDataFrame(rows, "x double, want double").select(round_binary("x", 6).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
    assert duckdb.sql("SELECT round(0.5045065::DOUBLE, 6)").fetchall() == [(0.504506,)]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name, keys, values", [
    ("corporate_action_episodes", ["entity", "episode"], ["factor", "ratio_error"]),
    ("score_blocks", ["entity", "d"], ["block_trend", "block_momentum", "block_risk", "total"]),
])
def test_same_digits_as_the_sql(spark, name, keys, values):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{FOLDER}/lineitem.parquet'")
    want = con.execute(ORACLE_SQL[name]).df()[keys + values].sort_values(keys, ignore_index=True)
    got = QUERIES[name](spark, FOLDER).select(*keys, *[F.col(v) for v in values]).toPandas().sort_values(keys, ignore_index=True)
    assert len(got) == len(want)
    for v in values:
        assert ((got[v] == want[v]) | (got[v].isna() & want[v].isna())).all(), v
