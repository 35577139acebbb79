"""Bars and panels: construction from trades, total-return adjustment, filters, de-duplication, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio, shielded


def adjust_total_return(raw: DataFrame, close: str = "close", adjusted: str = "adjustedClose") -> DataFrame:
    """Scale open, high and low by adjusted/close and take the adjusted close; volume stays."""
    factor = ratio(adjusted, close)
    cols = {x: F.col(x) * factor for x in ("open", "high", "low") if x in raw.columns}
    return raw.withColumns(cols).withColumn(close, F.col(adjusted)).drop(adjusted)


def in_universe(panel: DataFrame, tickers: list[str], keep: bool = True) -> DataFrame:
    inside = F.col("ticker").isin(tickers)
    return panel.where(inside if keep else ~inside)


def between_dates(panel: DataFrame, start: str, end: str) -> DataFrame:
    return panel.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def complete_cases(panel: DataFrame, columns: list[str]) -> DataFrame:
    return panel.na.drop(subset=columns)


def with_default(left: DataFrame, right: DataFrame, keys: list[str], column: str, default: float) -> DataFrame:
    """``left`` with ``column`` of ``right`` (one row a key), ``default`` where it has none or null."""
    return left.join(right.select(*keys, column), keys, "left").fillna({column: default})


def with_min_bars(panel: DataFrame, least: int = 300) -> DataFrame:
    """Tickers with at least ``least`` rows, counted before any de-duplication."""
    enough = panel.groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("ticker")
    return panel.join(enough, "ticker", "left_semi")


@shielded
def first_of_each(panel: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first by ``order``."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return panel.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def coverage(panel: DataFrame) -> DataFrame:
    return panel.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("ticker").alias("n_tickers"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )


def missing_tickers(panel: DataFrame, universe: DataFrame) -> DataFrame:
    return universe.select("ticker").join(panel.select("ticker"), "ticker", "left_anti")


def bar_index(panel: DataFrame) -> DataFrame:
    """``idx``: position of a bar within its ticker, from 1."""
    return panel.withColumn("idx", F.row_number().over(Window.partitionBy("ticker").orderBy("date")))


def trading_dates(panel: DataFrame) -> DataFrame:
    """(date, pos): distinct dates and their position from 0. The only window over one partition; its input has one
    row a date."""
    pos = F.row_number().over(Window.orderBy("date")) - 1
    return panel.select("date").distinct().withColumn("pos", pos)


def rebalance_dates(panel: DataFrame, stride: int) -> DataFrame:
    return trading_dates(panel).where(F.col("pos") % stride == 0)


def select_universe(stocks: DataFrame, n: int = 120, min_adv: float = 5e6) -> DataFrame:
    """Liquid tickers by market value: ``close * volume >= min_adv``, none that end in F, largest ``n``."""
    liquid = stocks.where((F.coalesce("close", F.lit(0.0)) != 0) & (F.coalesce("volume", F.lit(0.0)) != 0) & ~F.col("ticker").endswith("F"))
    liquid = liquid.withColumn("adv", F.col("close") * F.col("volume")).where(F.col("adv") >= min_adv)
    return liquid.orderBy(F.coalesce("market_cap", F.lit(0.0)).desc(), "ticker").limit(n)


@shielded
def adjustment_factor(bars: DataFrame, events: DataFrame) -> DataFrame:
    """``factor``: product of max(0, 1 - value/close_prior) over events after the bar's date.

    Each ticker's events, a short list, are multiplied up from the latest back; the running products are laid among the
    bars as rows, and each bar takes that of the next event after it: linear in bars, without joining bars to events.
    Events without a positive prior close or with a null date or value are ignored; several on one day count each;
    without any the factor is 1.
    """
    step = F.greatest(F.lit(0.0), 1 - F.col("value") / F.col("close_prior"))
    ev = events.where("close_prior > 0 and value is not null and ex_date is not null")
    listed = F.sort_array(F.collect_list(F.struct(F.col("ex_date").alias("date"), step.alias("step"))), asc=False)
    ev = ev.groupBy("ticker").agg(listed.alias("_e"))
    start = F.struct(F.lit(1.0).alias("p"), F.array().cast("array<double>").alias("all"))

    def multiply(acc, e):
        p = acc["p"] * e["step"]
        return F.struct(p.alias("p"), F.concat(acc["all"], F.array(p)).alias("all"))

    products = ev.select("ticker", "_e", F.aggregate("_e", start, multiply, lambda acc: acc["all"]).alias("_p"))
    marks = products.select("ticker", F.posexplode(F.arrays_zip("_e", "_p")).alias("_at", "_x"))
    marks = marks.select("ticker", F.col("_x._e.date").alias("date"), F.lit(0).alias("_side"), "_at", F.col("_x._p").alias("_f"))
    both = bars.withColumn("_side", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    # from the latest date back: a day's bars come before its events, which count only for earlier bars
    later = Window.partitionBy("ticker").orderBy(F.col("date").desc(), F.col("_side").desc(), "_at").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("factor", F.coalesce(F.last("_f", ignorenulls=True).over(later), F.lit(1.0)))
    return both.where("_side = 1").drop("_side", "_at", "_f")


def reference_difference(adjusted: DataFrame, reference: DataFrame) -> DataFrame:
    """Per cent difference of an adjusted close from a reference series on common dates."""
    r = reference.select("ticker", "date", F.col("close").alias("ref"))
    return adjusted.join(r, ["ticker", "date"]).withColumn("pct_diff", (F.col("close") / F.nullif("ref", F.lit(0.0)) - 1) * 100)


@shielded
def never_falls(df: DataFrame, column: str = "factor", slack: float = 1e-9) -> DataFrame:
    """Per ticker, whether ``column`` is non-decreasing in time."""
    step = F.col(column) - F.lag(column).over(Window.partitionBy("ticker").orderBy("date"))
    return df.withColumn("_s", step).groupBy("ticker").agg(F.bool_and(F.coalesce(F.col("_s") >= -slack, F.lit(True))).alias("rises"))
