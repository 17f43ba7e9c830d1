"""Quantiles by sketches and ranks are those of percentile(), with no task that holds all values."""

import pytest
from pyspark.sql import functions as F

from chronoframe.operators import models as M
from chronoframe.operators import stats as S

SHARES = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.9, 1.0]


@pytest.fixture
def rows(spark):
    x = F.rand(7) - 0.5
    return spark.range(0, 20_011, 1, 5).select("id", x.alias("x"), F.lit(1.0).alias("flat"), F.when(F.col("id") % 3 == 0, F.round(x, 1)).alias("ties"), F.lit(None).cast("double").alias("none"), F.when(F.col("id") == 5, 2.5).alias("one"))


@pytest.mark.parametrize("accuracy", [10, 10_000])
def test_same_as_percentile(rows, accuracy):
    names = ["x", "flat", "ties", "none", "one"]
    got = S.quantiles(rows, {c: (F.col(c), SHARES) for c in names}, accuracy)
    want = rows.agg(*[F.percentile(c, SHARES).alias(c) for c in names], *[F.count(c).alias(f"n_{c}") for c in names]).first()
    for c in names:
        assert got[c][0] == want[f"n_{c}"] and got[c][1] == pytest.approx(want[c] or [None] * len(SHARES), abs=1e-15), c


def test_a_quantile_missed_by_its_sketch_is_ranked_among_all(rows, monkeypatch):
    real = F.percentile_approx
    monkeypatch.setattr(S.F, "percentile_approx", lambda x, ps, a: F.transform(real(x, ps, a), lambda v: v + 5))
    assert S.quantiles(rows, {"x": (F.col("x"), [0.5])})["x"][1][0] == rows.agg(F.percentile("x", 0.5)).first()[0]


def test_no_task_holds_every_value(spark, rows, monkeypatch):
    """psi and select_features asked percentile() of the whole table for one group."""
    def never(*a):
        raise AssertionError("percentile of a whole table")

    monkeypatch.setattr(S.F, "percentile", never)
    assert S.psi(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), "x").first().status == "stable"
    more = rows.withColumn("twice", F.col("x") * 2)
    assert M.select_features(more, ["x", "twice", "flat", "none", "ties"], F.col("id") < 15_000) == ["twice"]
    assert not spark.sparkContext._jsc.getPersistentRDDs()
