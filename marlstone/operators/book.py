"""Long-short books, turnover and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.columns import beside, impact_bps, pct_rank, shielded
from .features import fundamental_features
from . import stats
from .labels import forward_return


def median_adv(panel: DataFrame) -> DataFrame:
    """(ticker, adv): exact median of traded value."""
    return panel.groupBy("ticker").agg(F.percentile(F.col("close") * F.col("volume"), F.lit(0.5)).alias("adv"))


@shielded
def book(scored: DataFrame, low: float, high: float, least: int, score: str = "score", ret: str = "fwd_ret", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, k, date, ticker, w, ret): equal-weighted legs of one half each on every date with ``least`` names.

    Longs reach the ``high`` quantile of the date's scores, shorts the ``low`` one. A name in both legs is short, while
    both legs' counts include it. ``k`` numbers the dates that pass. ``by`` names columns (a split, say) whose values
    have books of their own. Rows with a null score are in no book; an empty table gives none.
    """
    day = Window.partitionBy(*by, "date")
    df = scored.where(F.col(score).isNotNull())
    df = df.withColumns({
        "_n": F.count(F.lit(1)).over(day),
        "_hi": F.percentile(score, F.lit(high)).over(day),
        "_lo": F.percentile(score, F.lit(low)).over(day),
    }).where(F.col("_n") >= least)
    up, down = F.col(score) >= F.col("_hi"), F.col(score) <= F.col("_lo")
    df = df.withColumns({"_nl": F.count_if(up).over(day), "_ns": F.count_if(down).over(day)})
    df = df.where("_nl > 0 and _ns > 0 ")
    w = F.when(down, -0.5 / F.col("_ns")).when(up, 0.5 / F.col("_nl"))
    held = df.select(*by, "date", "ticker", w.alias("w"), F.col(ret).alias("ret")).where("w is not null")
    order = held.select(*by, "date").distinct().withColumn("k", F.row_number().over(_series(by)))
    return held.join(F.broadcast(order), [*by, "date"])  # one row a rebalance


def _series(by: tuple[str, ...]):
    """Window over dates, for each of ``by``: its rows are dates, never a panel's."""
    return (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("date")


def trades(held: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, k, ticker, dw): change against the book before. A book's weights count at k and, negated, at k + 1."""
    both = held.select(*by, "k", "ticker", "w").unionByName(held.select(*by, (F.col("k") + 1).alias("k"), "ticker", (-F.col("w")).alias("w")))
    moved = both.groupBy(*by, "k", "ticker").agg(F.sum("w").alias("dw"))
    if by:
        last = held.groupBy(*by).agg(F.max("k").alias("_last"))
        return moved.join(F.broadcast(last), list(by)).where("k <= _last").drop("_last")  # one row for each of by
    return beside(moved, held.agg(F.max("k").alias("_last"))).where("k <= _last").drop("_last")


def turnover(held: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return trades(held, by).groupBy(*by, "k").agg(F.sum(F.abs("dw")).alias("turnover"))


def costed(held: DataFrame, adv: DataFrame, capital: float = 2e7, half_spread: float = 10.0, sigma: float = 0.025, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, date, k, gross, cost, net, turnover) of each rebalance; missing or non-positive ADV counts as 1 % participation."""
    moved = trades(held, by).where("dw <> 0").join(adv, "ticker", "left")
    part = F.when(F.col("adv") > 0, F.abs("dw") * capital / F.nullif(F.col("adv"), F.lit(0.0))).otherwise(F.lit(0.01))
    leg = F.abs("dw") * (F.lit(half_spread) + impact_bps(part, sigma)) / 1e4
    paid = moved.groupBy(*by, "k").agg(F.sum(leg).alias("cost"), F.sum(F.abs("dw")).alias("turnover"))
    earned = held.groupBy(*by, "k", "date").agg(F.sum(F.coalesce(F.col("w") * F.col("ret"), F.lit(0.0))).alias("gross"))
    out = earned.join(paid, [*by, "k"], "left").fillna({"cost": 0.0, "turnover": 0.0})
    return out.withColumn("net", F.col("gross") - F.col("cost"))


def on_stride(scored: DataFrame, stride: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows on every ``stride``-th date of the table, or of each of ``by``."""
    dates = scored.select(*by, "date").distinct().withColumn("_pos", F.row_number().over(_series(by)) - 1)
    chosen = dates.where(F.col("_pos") % stride == 0).drop("_pos")
    return scored.join(F.broadcast(chosen), [*by, "date"], "left_semi")


def costed_backtest(scored: DataFrame, adv: DataFrame, stride: int = DEFAULT.horizon, frac: float = 0.5, least: int = 4, by: tuple[str, ...] = (), **costs) -> DataFrame:
    return costed(book(on_stride(scored, stride, by), frac, 1 - frac, least, by=by), adv, by=by, **costs)


@shielded
def long_short_sensor(scored: DataFrame, score: str = "score", ret: str = "fwd_ret", least: int = 4, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, date, ls): mean return above minus below the date's median score; names on it count in neither."""
    day = Window.partitionBy(*by, "date")
    df = scored.where(F.col(score).isNotNull()).withColumns({"_m": F.percentile(score, F.lit(0.5)).over(day), "_n": F.count(F.lit(1)).over(day)})
    up = F.avg(F.when(F.col(score) > F.col("_m"), F.col(ret)))
    down = F.avg(F.when(F.col(score) < F.col("_m"), F.col(ret)))
    return df.where(F.col("_n") >= least).groupBy(*by, "date").agg((up - down).alias("ls")).where("ls is not null")


@shielded
def sized_long_short(sized: DataFrame, weight: str = "size", ret: str = "fwd_ret", least: int = 4, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, date, ls): return weighted by signed size; a missing return earns nothing and keeps its weight below."""
    gross = F.sum(F.abs(weight))
    out = sized.groupBy(*by, "date").agg(
        F.count(F.lit(1)).alias("_n"), gross.alias("_g"), F.sum(F.coalesce(F.col(weight) * F.col(ret), F.lit(0.0))).alias("_s")
    )
    return out.where((F.col("_n") >= least) & (F.col("_g") >= 1e-9)).select(*by, "date", (F.col("_s") / F.col("_g")).alias("ls"))


def fundamental_tilt(panel: DataFrame, fundamentals: DataFrame, stride: int = DEFAULT.rebalance, least: int = 12, capital: float = 2e6, half_spread: float = 5.0, sigma: float = 0.025) -> DataFrame:
    """Quarterly value and quality book: terciles of the mean rank of three factors, costed on what is traded."""
    factors = ("earnings_yield", "book_to_price", "profit_margin")
    df = fundamental_features(panel, fundamentals)
    df = df.withColumns({f"_{x}": pct_rank(x) for x in factors})
    known = sum(F.col(f"_{x}").isNotNull().cast("int") for x in factors)
    score = sum(F.coalesce(f"_{x}", F.lit(0.0)) for x in factors) / F.nullif(known, F.lit(0))
    df = forward_return(df.withColumn("score", score), stride, "fwd_ret")
    on = on_stride(df, stride).where("score is not null and fwd_ret is not null")
    return costed(book(on, 1 / 3, 2 / 3, least), median_adv(panel), capital, half_spread, sigma)


def tilt_summary(rebalances: DataFrame, log: DataFrame, stride: int = DEFAULT.rebalance) -> DataFrame:
    """One row on the book of :func:`fundamental_tilt`: Sharpe gross and net, annualised, its probability of being above 0
    and above the best of the trials in ``log`` (which holds this one)."""
    gross = rebalances.agg(stats.sharpe("gross").alias("sharpe_gross"))
    out = beside(stats.summary(rebalances, "net"), gross).withColumn("nd", F.col("n").cast("double"))
    out = stats.probabilistic_sharpe(out, "sharpe", "nd", skew="skew", kurt="kurt")
    out = stats.deflated_sharpe(out, log, "sharpe", "nd")
    annual = F.col("sharpe") * (252 / stride) ** 0.5
    return out.select(F.col("n").alias("rebalances"), "sharpe_gross", F.col("sharpe").alias("sharpe_net"), annual.alias("annualised"), "psr", "dsr", (F.col("sharpe") > 0).alias("success"))
