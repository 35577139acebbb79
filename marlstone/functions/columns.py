"""Column-level building blocks: null-safe arithmetic, guarded rolling windows, cross-sectional ranks, costs."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

TICKER = ("ticker",)


def shielded(operator):
    """Let a caller's columns that begin with ``_`` pass through: operators name their temporary columns so.

    Columns that an argument names are left alone; renaming costs nothing in the optimised plan.
    """

    @wraps(operator)
    def run(panel: DataFrame, *args, **how):
        named = {a for a in (*args, *how.values()) if isinstance(a, str)}
        safe = {x: f"kept{i}{x}" for i, x in enumerate(panel.columns) if x.startswith("_") and x not in named}
        if not safe:
            return operator(panel, *args, **how)
        out = operator(panel.withColumnsRenamed(safe), *args, **how)
        return out.withColumnsRenamed({v: k for k, v in safe.items()})

    return run


def beside(df: DataFrame, one: DataFrame) -> DataFrame:
    """``df`` with the columns of a table of one row, joined on a constant key and broadcast."""
    return df.withColumn("_k", F.lit(1)).join(F.broadcast(one.withColumn("_k", F.lit(1))), "_k").drop("_k")


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def by_ticker() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("date")


def nonzero(x: Column | str) -> Column:
    """``x``, or null where it is zero: a denominator that cannot fail."""
    return F.nullif(c(x), F.lit(0.0))


def ratio(a: Column | str, b: Column | str) -> Column:
    return c(a) / nonzero(b)


def at_least(x: Column | str, low: float) -> Column:
    """One-sided clamp that keeps null (``greatest`` alone would skip it)."""
    return F.when(c(x).isNotNull(), F.greatest(c(x), F.lit(low)))


def at_most(x: Column | str, high: float) -> Column:
    return F.when(c(x).isNotNull(), F.least(c(x), F.lit(high)))


def log(x: Column | str) -> Column:
    """Natural logarithm, null for what is not positive or not a number."""
    return F.when((c(x) > 0) & ~F.isnan(c(x)), F.ln(c(x)))


def root(x: Column | str) -> Column:
    """Square root, null (not NaN) below zero."""
    return F.when(c(x) >= 0, F.sqrt(c(x)))


def rolling(agg, x: Column | str, n: int, w: WindowSpec | None = None) -> Column:
    """``agg(x)`` over the last ``n`` rows, null unless all ``n`` values are known."""
    frame = (w or by_ticker()).rowsBetween(-(n - 1), 0)
    return F.when(F.count(c(x)).over(frame) == n, agg(c(x)).over(frame))


def log_return(close: Column | str = "close") -> Column:
    return log(c(close) / F.lag(c(close)).over(by_ticker()))


def pct_rank(x: str, key: str = "date") -> Column:
    """Rank over the non-null count with ties averaged; null stays null."""
    inside = Window.partitionBy(key, F.col(x).isNull())
    ties = F.count(F.lit(1)).over(Window.partitionBy(key, x))
    place = F.rank().over(inside.orderBy(x)) + (ties - 1) / 2
    return F.when(F.col(x).isNotNull(), place / F.count(F.lit(1)).over(inside))


def average_rank(x: str, *keys: str) -> Column:
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, x))
    return F.rank().over(Window.partitionBy(*keys).orderBy(x)) + (ties - 1) / 2


def impact_bps(participation: Column, sigma: float | Column, eta: float = 1.0) -> Column:
    """Square-root market impact in basis points; participation below zero counts as zero."""
    return F.lit(eta) * (F.lit(sigma) if not isinstance(sigma, Column) else sigma) * F.sqrt(F.greatest(participation, F.lit(0.0))) * 1e4


def round_trip_bps(participation: Column, sigma: float, half_spread: float = 10.0, eta: float = 1.0) -> Column:
    return 2.0 * (F.lit(half_spread) + impact_bps(participation, sigma, eta))


def net_of_costs(ret: Column, turnover: Column, participation: Column, sigma: float, half_spread: float = 10.0, eta: float = 1.0) -> Column:
    """One leg of cost on what was traded."""
    return ret - turnover * (F.lit(half_spread) + impact_bps(participation, sigma, eta)) / 1e4
