"""Panels derived from the star-schema tables; ``oracles.py`` states the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _damped(x) -> object:
    return F.round(100 * F.pow(x / 2000.0, F.lit(0.02)), 6)


def money(x: str):
    return F.col(x).cast("decimal(18,2)")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their brand as ticker; the part table joins on its key and is pruned to two columns."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker"), "p_retailprice")
    return li.join(part, li.l_partkey == part.p_partkey).withColumn("date", F.col("l_shipdate").cast("date"))


def bars(spark: SparkSession, sf_dir: str, with_open: bool = False) -> DataFrame:
    """Daily bars: damped volume-weighted price, high and low of unit prices, volume."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    aggs = [
        _damped(F.sum(money("l_extendedprice")).cast("double") / F.sum("l_quantity")).alias("close"),
        _damped(F.max(unit)).alias("high"),
        _damped(F.min(unit)).alias("low"),
        F.sum("l_quantity").alias("volume"),
    ]
    if with_open:
        first = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        aggs.append(_damped(F.min_by(unit, first)).alias("open"))
    return trades(spark, sf_dir).groupBy("ticker", "date").agg(*aggs)


def raw_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with an adjusted close: the close less a tenth of the day's mean discount."""
    day = trades(spark, sf_dir).groupBy("ticker", "date").agg(
        (F.sum(F.col("l_discount").cast("decimal(4,2)")).cast("double") / F.count(F.lit(1))).alias("discount")
    )
    return bars(spark, sf_dir, True).join(day, ["ticker", "date"]).withColumn("adjustedClose", F.col("close") * (1 - F.col("discount") / 10)).drop("discount")


def fundamentals(spark: SparkSession, sf_dir: str, lag_days: int = 90) -> DataFrame:
    """Quarterly aggregates per brand; every fifth row misses its earnings."""
    quarter = F.date_sub(F.add_months(F.trunc("date", "quarter"), 3), 1)
    rows = F.count(F.lit(1))
    mean = lambda x: F.sum(F.col(x).cast("decimal(4,2)")).cast("double") / rows
    earned = F.sum(money("l_extendedprice") * F.col("l_discount").cast("decimal(4,2)")).cast("double")
    q = trades(spark, sf_dir).groupBy("ticker", quarter.alias("end_date")).agg(
        (F.sum(money("p_retailprice")).cast("double") / rows).alias("book_value"),
        (earned / F.sum("l_quantity")).alias("eps"),
        (1 - mean("l_discount") - mean("l_tax")).alias("profit_margin"),
        mean("l_tax").alias("div_yield_raw"),
    )
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("ticker").orderBy("end_date"))
    return q.select(
        "ticker", "end_date", "book_value", F.when(n % 5 != 0, F.col("eps")).alias("trailing_eps"), "profit_margin", "div_yield_raw",
        F.date_add("end_date", lag_days).alias("available"),
    )


def corporate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event a ticker and year on its first bar: value is the day's mean discount, the prior close is 1."""
    day = trades(spark, sf_dir).groupBy("ticker", "date").agg(
        (F.sum(F.col("l_discount").cast("decimal(4,2)")).cast("double") / F.count(F.lit(1))).alias("value")
    )
    first = day.groupBy("ticker", F.year("date").alias("y")).agg(F.min_by("value", "date").alias("value"), F.min("date").alias("ex_date"))
    return first.select("ticker", "ex_date", "value", F.lit(1.0).alias("close_prior"))


def stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a listing: price, a volume and a market value; some tickers end in F."""
    p = table(spark, sf_dir, "part")
    name = F.concat(F.lit("P"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 7 == 0, "F").otherwise(""))
    return p.select(
        name.alias("ticker"), F.col("p_retailprice").alias("close"), (F.col("p_size") * 100.0).alias("volume"),
        F.when(F.col("p_partkey") % 11 != 0, F.round(F.col("p_retailprice") * F.col("p_partkey"), 2)).alias("market_cap"),
    )
