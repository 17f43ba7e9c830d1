"""Queries that take their whole table: nothing is left out by an id, a stride or a time span."""

import os

import pytest
from pyspark.sql import functions as F

from chronoframe.catalog import QUERIES
from chronoframe.operators import models as M
from chronoframe.operators import portfolio as Po
from chronoframe.plans.bindings import Tables
from chronoframe.queries.similarity import state

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def entities(spark):
    return {r.entity for r in Tables(spark, FOLDER).panel().select("entity").distinct().collect()}


@tables
@pytest.mark.parametrize("name, column", [("covariance_matrix", "i"), ("covariance_matrix", "j"), ("risk_contributions", "entity"), ("inverse_volatility_weights", "entity"), ("optimised_weights", "entity"), ("marginal_impact", "entity")])
def test_portfolio_holds_every_entity(spark, name, column):
    assert {r[0] for r in QUERIES[name](spark, FOLDER).select(column).distinct().collect()} == entities(spark)


def test_more_candidates_than_the_bound_raise(spark):
    n = 8
    cov = spark.range(n).withColumnRenamed("id", "i").crossJoin(spark.range(n).withColumnRenamed("id", "j"))
    cov = cov.withColumn("c", F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.1)).withColumn("n", F.lit(80)).orderBy("i", "j")
    assert Po.optimised(cov, most=8).count() == 4 * n
    with pytest.raises(ValueError, match="more than 7"):
        Po.optimised(cov, most=7)
    with pytest.raises(ValueError, match="more than 2"):
        Po.optimised(cov, most=2)
    assert all(abs(sum(r.weight for r in rows) - 1) < 1e-9 for rows in by_method(Po.optimised(cov).collect()).values())


def by_method(rows):
    out = {}
    for r in rows:
        out.setdefault(r.method, []).append(r)
    return out


@tables
@pytest.mark.parametrize("name", ["continuous_contract", "futures_adjusted", "futures_basis"])
def test_chain_has_every_day(spark, name):
    days = {r.d for r in Tables(spark, FOLDER).panel().select("d", "entity").where("d <= date_add(date'1995-03-31', cast(entity * 91 as int))").distinct().collect()}
    assert {r.d for r in QUERIES[name](spark, FOLDER).select("d").collect()} == days


def test_chain_takes_contracts_past_the_twentieth(spark, tmp_path):
    days = [(k, f"{1995 + k // 12:04d}-{k % 12 + 1:02d}-15", e) for k in range(80) for e in (1, 12, 20, 21, 30)]
    rows = [(e, k, 1, d, 10.0 * e, 2.0) for k, d, e in days]
    spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_linenumber int, l_shipdate string, l_extendedprice double, l_quantity double").withColumn("l_shipdate", F.to_date("l_shipdate")).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {str(r.d): r.contract for r in QUERIES["continuous_contract"](spark, str(tmp_path)).collect()}
    assert len(got) == 80 and got["1995-01-15"] == 1 and got["2000-04-15"] == 21 and got["2001-08-15"] == 30
    assert {r.new for r in QUERIES["futures_rolls"](spark, str(tmp_path)).collect()} == {12, 20, 21, 30}


@tables
def test_replay_has_a_cutoff_at_every_state_with_a_known_past(spark):
    got = {r.cutoff for r in QUERIES["walk_forward_replay"](spark, FOLDER).select("cutoff").collect()}
    positions = {r.pos for r in state(Tables(spark, FOLDER)).select("pos").collect()}
    assert got == {p for p in positions if p > min(positions) + 20}


def test_nearest_pairs_are_by_state_at_any_distance_in_time(spark):
    rows = [(0, 0.0), (31, 5.0), (59, 5.1), (2000, 0.01), (2031, 5.05)]
    got = M.nearest_pairs(spark.createDataFrame(rows, "id long, x double"), "id", ["x"], 1).collect()
    assert {(r.src, r.dst) for r in got} == {(0, 2000), (31, 2031), (59, 2031)}
    assert all(0 < r.weight <= 1 for r in got)


@tables
def test_spectral_regimes_have_every_month(spark):
    months = state(Tables(spark, FOLDER)).na.drop().select(F.trunc("d", "month")).distinct().count()
    got = QUERIES["spectral_regimes"](spark, FOLDER).collect()
    assert len(got) == len({r.id for r in got}) == months and len({r.cluster for r in got}) == 2
