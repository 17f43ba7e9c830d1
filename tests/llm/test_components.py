"""Components are whole, or an error."""

import pytest

from chronoframe.llm import common


def test_a_chain_that_needs_more_rounds_raises(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "u long, v long")
    with pytest.raises(RuntimeError, match="after 1 rounds"):
        common.components(chain, rounds=1)
    got = {r.node: r.component for r in common.components(chain).collect()}
    assert got == dict.fromkeys(range(41), 0)


def test_no_links_have_no_components(spark):
    loops = spark.createDataFrame([(1, 1), (2, None)], "u long, v long")
    assert common.components(loops, rounds=1).count() == 0


def test_a_long_chain_is_whole(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(500)], "u long, v long")
    got = {r.node: r.component for r in common.components(chain).collect()}
    assert got == dict.fromkeys(range(501), 0)


class Session:
    """What scratch() asks of a session, with another master and folder."""

    def __init__(self, spark, master, folder):
        real = spark.sparkContext
        self.sparkContext = type("C", (), {"master": master, "applicationId": f"{master}{folder}", "_jvm": real._jvm, "_jsc": real._jsc})()
        self.conf = type("F", (), {"get": staticmethod(lambda name, default=None: folder)})()


def test_scratch_space_is_shared_or_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch(Session(spark, "spark://host:7077", None), "x")
    default = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(spark.sparkContext._jsc.hadoopConfiguration()).toString()
    uri = common.scratch(Session(spark, "spark://host:7077", str(tmp_path / "c")), "x")
    assert uri.startswith(default.split("://")[0]) and "/c/chronoframe-" in uri


def test_few_keys_are_the_smallest_by_hash(spark):
    from pyspark.sql import functions as F

    rows = spark.range(5000).selectExpr("id % 1000 AS k").unionByName(spark.range(1).selectExpr("CAST(NULL AS BIGINT) AS k"))
    got = {r.key for r in common.few_keys(rows, "k", 50).collect()}
    want = [r.id for r in spark.range(1000).orderBy(F.xxhash64("id")).limit(50).collect()]
    assert got == set(want)
    assert {r.key for r in common.few_keys(rows, "k", 5000).collect()} == set(range(1000))
    assert common.few_keys(rows.limit(0), "k", 5).count() == 0
