"""How the engine's roles are bound to the test tables: panel, sessions, observations, segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """The tables of one folder and the views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def panel(self, entity: str = "l_suppkey", together: bool = False) -> DataFrame:
        """(entity, d, open, high, low, close, value, volume, trades): a row an entity and day.  Together:
        an entity's rows are brought to one task first, so windows by entity need no second shuffle."""
        price = F.col("l_extendedprice") / F.col("l_quantity")
        rows = self("lineitem").select(F.col(entity).alias("entity"), F.to_date("l_shipdate").alias("d"), "l_extendedprice", "l_quantity", "l_orderkey", "l_linenumber")
        rows = (rows.repartition("entity") if together else rows).withColumn("price", price)
        at = F.struct("l_orderkey", "l_linenumber", "price")
        return rows.groupBy("entity", "d").agg(
            F.round(F.min_by("price", at), 8).alias("open"), F.round(F.max("price"), 8).alias("high"), F.round(F.min("price"), 8).alias("low"),
            F.round(F.avg("price"), 8).alias("close"), F.round(F.sum("l_extendedprice"), 2).alias("value"),
            F.sum("l_quantity").alias("volume"), F.count("*").alias("trades"))

    def market(self) -> DataFrame:
        """(d, close, value, volume): the index, all entities together."""
        price = F.col("l_extendedprice") / F.col("l_quantity")
        return self("lineitem").groupBy(F.to_date("l_shipdate").alias("d")).agg(F.round(F.avg(price), 8).alias("close"), F.round(F.sum("l_extendedprice"), 2).alias("value"), F.sum("l_quantity").alias("volume"))

    def boards(self) -> DataFrame:
        """The panel by board: the return flag stands for the trading board."""
        price = F.col("l_extendedprice") / F.col("l_quantity")
        return self("lineitem").groupBy(F.col("l_suppkey").alias("entity"), F.col("l_returnflag").alias("board"), F.to_date("l_shipdate").alias("d")).agg(F.round(F.avg(price), 8).alias("close"), F.round(F.sum("l_extendedprice"), 2).alias("value"), F.sum("l_quantity").alias("volume"))

    def observations(self) -> DataFrame:
        """(series, observed, available, vintage, value): orders as published facts, known days later."""
        o = self("orders")
        d = F.to_date("o_orderdate")
        return o.select(F.col("o_orderpriority").alias("series"), d.alias("observed"), F.date_add(d, (F.col("o_orderkey") % 7).cast("int") + 1).alias("available"), F.col("o_orderkey").alias("vintage"), F.col("o_totalprice").alias("value"))

    def statements(self) -> DataFrame:
        """(issuer, period, available, profit, equity, shares): quarterly sums by customers' nation."""
        o, c = self("orders"), self("customer")
        period = F.to_date(F.date_trunc("quarter", F.col("o_orderdate")))
        rows = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("issuer"), period.alias("period"))
        rows = rows.agg(F.round(F.sum("o_totalprice"), 2).alias("profit"), F.round(F.sum(F.abs("c_acctbal")), 2).alias("equity"), F.count("*").alias("shares"))
        return rows.withColumn("available", F.date_add("period", 120))


#: The same views in SQL, for the oracle.
SQL_VIEWS = {
    "panel": """SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS d,
    round(arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_extendedprice / l_quantity)), 8) AS open,
    round(max(l_extendedprice / l_quantity), 8) AS high, round(min(l_extendedprice / l_quantity), 8) AS low,
    round(avg(l_extendedprice / l_quantity), 8) AS close, round(sum(l_extendedprice), 2) AS value,
    sum(l_quantity) AS volume, count(*) AS trades FROM lineitem GROUP BY 1, 2""",
    "market": """SELECT CAST(l_shipdate AS DATE) AS d, round(avg(l_extendedprice / l_quantity), 8) AS close,
    round(sum(l_extendedprice), 2) AS value, sum(l_quantity) AS volume FROM lineitem GROUP BY 1""",
    "boards": """SELECT l_suppkey AS entity, l_returnflag AS board, CAST(l_shipdate AS DATE) AS d,
    round(avg(l_extendedprice / l_quantity), 8) AS close, round(sum(l_extendedprice), 2) AS value,
    sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2, 3""",
    "observations": """SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS observed,
    CAST(o_orderdate AS DATE) + CAST(o_orderkey % 7 + 1 AS INTEGER) AS available, o_orderkey AS vintage,
    o_totalprice AS value FROM orders""",
    "statements": """SELECT issuer, period, profit, equity, shares, period + 120 AS available FROM (
    SELECT c_nationkey AS issuer, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, round(sum(o_totalprice), 2) AS profit,
    round(sum(abs(c_acctbal)), 2) AS equity, count(*) AS shares FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)""",
    "ret": """SELECT *, CASE WHEN prev <> 0 THEN close / prev - 1 END AS r FROM (
    SELECT *, lag(close) OVER (PARTITION BY entity ORDER BY d) AS prev FROM panel)""",
    "mret": """SELECT *, CASE WHEN prev <> 0 THEN close / prev - 1 END AS r FROM (
    SELECT *, lag(close) OVER (ORDER BY d) AS prev FROM market)""",
}
