"""Scans: fixed-width quote files, price and fundamentals JSON, dividend feeds. Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT

BAR = "date long, open double, high double, low double, close double, adjustedClose double, volume double"
RESULT_FIELDS = "symbol:string,requestedSymbol:string,historicalDataPrice:array<struct<" + BAR.replace(", ", ",").replace(" ", ":") + ">>"
QUARTER = "endDate string, bookValue double, trailingEps double, earningsPerShare double, profitMargins double, dividendYield double, yield double"

# Fixed values: (first position from 1, length) of each field of the quote record.
FIELDS = {"kind": (1, 2), "date": (3, 8), "codbdi": (11, 2), "ticker": (13, 12), "market": (25, 3), "open": (57, 13), "high": (70, 13), "low": (83, 13), "close": (109, 13), "quantity": (153, 18)}


def fixed_width(lines: DataFrame, tickers: list[str] | None = None) -> DataFrame:
    """Bars from quote records (column value): standard lot, cash market; prices carry two implied decimals.

    Record filters come before any cast, so other record kinds are never parsed.
    """
    part = {k: F.substring("value", a, n) for k, (a, n) in FIELDS.items()}
    rows = lines.where((part["kind"] == "01") & (part["codbdi"] == "02") & (part["market"] == "010"))
    rows = rows.withColumn("ticker", F.trim(part["ticker"]))
    if tickers is not None:
        rows = rows.where(F.col("ticker").isin(tickers))
    price = lambda k: (part[k].try_cast("long") / 100.0).alias(k)
    return rows.select(
        F.to_date(F.try_to_timestamp(part["date"], F.lit("yyyyMMdd"))).alias("date"), "ticker",
        *[price(k) for k in ("open", "high", "low", "close")], part["quantity"].try_cast("long").alias("volume"),
    )


def render_fixed_width(bars: DataFrame) -> DataFrame:
    """The inverse: one quote record for each bar, for tests and exports."""
    put = lambda c, n: F.lpad(F.round(F.col(c) * 100).cast("long").cast("string"), n, "0")
    line = F.concat(
        F.lit("01"), F.date_format("date", "yyyyMMdd"), F.lit("02"), F.rpad("ticker", 12, " "), F.lit("010"), F.lpad(F.lit(""), 29, " "),
        put("open", 13), put("high", 13), put("low", 13), F.lpad(F.lit(""), 13, " "), put("close", 13), F.lpad(F.lit(""), 31, " "),
        F.lpad(F.col("volume").cast("long").cast("string"), 18, "0"),
    )
    return bars.select(line.alias("value"))


def read_fixed_width(spark: SparkSession, path: str, tickers: list[str] | None = None) -> DataFrame:
    return fixed_width(spark.read.text(path), tickers)


def _bars(results: DataFrame) -> DataFrame:
    """(date, ticker, prices) of rows with a struct column r; epoch seconds are UTC."""
    rows = results.select(F.coalesce("r.requestedSymbol", "r.symbol").alias("ticker"), F.explode("r.historicalDataPrice").alias("b"))
    return rows.select(
        F.to_date(F.timestamp_seconds("b.date")).alias("date"), "ticker", "b.open", "b.high", "b.low", "b.close", "b.adjustedClose", "b.volume"
    )


def price_envelope(texts: DataFrame) -> DataFrame:
    """Bars from files (column value) that hold blocks {type, text}: the last text that begins with { is the payload."""
    blocks = F.coalesce(
        F.from_json("value", "array<struct<type:string,text:string>>"),
        F.array(F.from_json("value", "struct<type:string,text:string>")),
    )
    payload = F.filter(blocks, lambda b: F.ltrim(b["text"]).startswith("{"))
    rows = texts.select(F.try_element_at(payload, F.lit(-1))["text"].alias("t")).where("t is not null")
    rows = rows.select(F.explode(F.from_json("t", f"results array<struct<{RESULT_FIELDS}>>")["results"]).alias("r"))
    return _bars(rows)



def price_rest(texts: DataFrame) -> DataFrame:
    """Bars from cached responses, one result a file; columns that are missing are null."""
    return _bars(texts.select(F.from_json("value", f"struct<{RESULT_FIELDS}>").alias("r")))


def fundamentals_json(texts: DataFrame, lag_days: int = DEFAULT.lag_days) -> DataFrame:
    """Quarterly rows, known ``lag_days`` after the quarter's end. Zero earnings or yield fall back like missing ones."""
    schema = "struct<symbol:string,data:array<struct<" + QUARTER.replace(", ", ",").replace(" ", ":") + ">>>"
    rows = texts.select(F.from_json("value", schema).alias("r")).select("r.symbol", F.explode("r.data").alias("q"))
    rows = rows.where(F.coalesce(F.col("q.endDate"), F.lit("")) != "")
    either = lambda a, b: F.coalesce(F.nullif(F.col(f"q.{a}"), F.lit(0.0)), F.col(f"q.{b}"))
    end = F.col("q.endDate").substr(1, 10).try_cast("date")
    return rows.select(
        F.col("symbol").alias("ticker"), end.alias("end_date"), F.col("q.bookValue").alias("book_value"),
        either("trailingEps", "earningsPerShare").alias("trailing_eps"), F.col("q.profitMargins").alias("profit_margin"),
        either("dividendYield", "yield").alias("div_yield_raw"), F.date_add(end, lag_days).alias("available"),
    )


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Whole files in column value."""
    return spark.read.text(path, wholetext=True)


def decimal_comma(x) -> object:
    """Number written with . for thousands and , for decimals; null if it is none."""
    return F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def dividends(feed: DataFrame) -> DataFrame:
    """(ex_date, value, close_prior, type_stock, action) from feed rows of strings; malformed ones go."""
    day = F.to_date(F.try_to_timestamp("lastDatePriorEx", F.lit("dd/MM/yyyy")))
    rows = feed.select(
        F.date_add(day, 1).alias("ex_date"), decimal_comma(F.col("valueCash")).alias("value"),
        decimal_comma(F.col("closingPricePriorExDate")).alias("close_prior"), F.col("typeStock").alias("type_stock"), F.col("corporateAction").alias("action"),
    )
    return rows.where("ex_date is not null and value > 0 and close_prior > 0")


def dividends_of_eras(feeds: list[DataFrame], type_stock: str = "ON") -> DataFrame:
    """Feeds of one company under several names, one row for each (ex_date, value), in order."""
    both = feeds[0]
    for f in feeds[1:]:
        both = both.unionByName(f)
    one = both.where(F.col("type_stock") == type_stock).groupBy("ex_date", "value")
    return one.agg(F.min("close_prior").alias("close_prior"), F.min("type_stock").alias("type_stock"), F.min("action").alias("action")).orderBy("ex_date", "value")


def write_panel(panel: DataFrame, path: str) -> None:
    """Snapshot of a panel, sorted within files by ticker and date so that ticker filters skip row groups."""
    panel.repartition("ticker").sortWithinPartitions("ticker", "date").write.mode("overwrite").parquet(path)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
