"""Point-in-time features: price, microstructure, regime, fundamental. Each uses rows up to its own only.

All per-ticker features of a family share one window specification, so a family costs one exchange and one sort.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.columns import at_least, at_most, by_ticker, log, log_return, nonzero, pct_rank, ratio, rolling, root, shielded

PRICE = ("mom_5", "mom_10", "mom_21", "vol_10", "vol_21", "dist_sma21", "rsi_14", "fd_close", "fd_vol21")
MICRO = ("amihud", "roll_spread", "dollar_vol_z", "turnover_accel")
REGIME = ("cusum_vol", "explosivity", "vol_regime")
FUNDAMENTAL = ("earnings_yield", "book_to_price", "profit_margin", "div_yield")


# ---- exponentially weighted and fractional-difference sums ---------------------------------------------------------


def ewm_sums(panel: DataFrame, sums: dict[str, tuple[Column, float]]) -> DataFrame:
    """Adds, for each (x, decay), the sum over a ticker's bars so far of x * decay**age; null ``x`` counts as nothing.

    A closed form by powers of ``decay`` overflows on long histories, so bars are cut into blocks whose powers stay
    below e**200: a running sum inside the block plus what the block before has left. What lies two blocks back weighs
    less than e**-200, nothing in double arithmetic. Both sums use one exchange by ticker, whatever the history's length.
    """
    length = max(1, int(min(200 / -np.log(decay) for _, decay in sums.values())))
    i = F.row_number().over(by_ticker()) - 1
    df = panel.withColumns({f"_x_{k}": x for k, (x, _) in sums.items()})
    df = df.withColumns({"_block": F.floor(i / length), "_at": (i % length).cast("double")})
    order = Window.partitionBy("ticker").orderBy("_block", "_at")
    inside = Window.partitionBy("ticker", "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    local = {f"_s_{k}": F.sum(F.coalesce(F.col(f"_x_{k}") * F.pow(F.lit(d), -F.col("_at")), F.lit(0.0))).over(inside) * F.pow(F.lit(d), F.col("_at")) for k, (_, d) in sums.items()}
    df = df.withColumns(local)
    df = df.withColumns({f"_c_{k}": F.when(F.col("_at") == 0, F.lag(f"_s_{k}").over(order)) for k in sums})
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    carried = {k: F.coalesce(F.last(f"_c_{k}", ignorenulls=True).over(so_far), F.lit(0.0)) for k in sums}
    df = df.withColumns({k: F.col(f"_s_{k}") + carried[k] * F.pow(F.lit(d), F.col("_at") + 1) for k, (_, d) in sums.items()})
    return df.drop("_block", "_at", *[f"_{p}_{k}" for k in sums for p in "xsc"])


@shielded
def daily_vol(panel: DataFrame, span: int = DEFAULT.vol_span) -> DataFrame:
    """``sigma``: bias-corrected exponentially weighted deviation of log returns.

    Null until a ticker has two known returns and where a return is not a number; a null return is skipped but ages the
    others. Rows of one ticker and date are taken in any order; an empty panel gives no row.
    """
    decay = 1 - 2 / (span + 1)
    rows = panel.withColumn("_lr", log_return())
    seen = F.when(F.col("_lr").isNotNull(), 1.0)
    x = F.col("_lr")
    rows = ewm_sums(rows, {"_m1": (x, decay), "_m2": (x * x, decay), "_w1": (seen, decay), "_w2": (seen, decay * decay)})
    rows = rows.withColumn("_n", F.count("_lr").over(by_ticker().rowsBetween(Window.unboundedPreceding, 0)))
    w1, mean = nonzero("_w1"), ratio("_m1", "_w1")
    var = (F.col("_m2") / w1 - mean * mean) * w1 * w1 / nonzero(w1 * w1 - F.col("_w2"))
    sigma = F.when(F.col("_n") >= 2, F.sqrt(F.greatest(var, F.lit(0.0))))
    return rows.withColumn("sigma", F.when(~F.isnan(sigma), sigma)).drop("_lr", "_m1", "_m2", "_w1", "_w2", "_n")


def ffd_weights(d: float = DEFAULT.fd_d, thresh: float = DEFAULT.fd_thresh) -> list[float]:
    """Fractional-difference weights down to the first that is smaller than ``thresh``."""
    out = [1.0]
    while True:
        k = len(out)
        nxt = -out[-1] * (d - k + 1) / k
        if abs(nxt) < thresh:
            return out
        out.append(nxt)


def frac_diff(x: Column, d: float = DEFAULT.fd_d, thresh: float = DEFAULT.fd_thresh) -> Column:
    """Fixed-width fractional difference; null if any value of the window is."""
    w = by_ticker()
    return reduce(lambda a, b: a + b, [(F.lag(x, k).over(w) if k else x) * v for k, v in enumerate(ffd_weights(d, thresh))])


# ---- price -------------------------------------------------------------------------------------------------------


@shielded
def price_features(panel: DataFrame, columns: tuple[str, ...] = PRICE) -> DataFrame:
    """Adds the chosen price features; each is null until its whole window is known."""
    w, close = by_ticker(), F.col("close")
    keep = [*panel.columns, *columns]
    df = panel.withColumns({"_lr": log_return(), "_lc": log("close"), "_d": close - F.lag("close").over(w)})
    made = {
        **{f"mom_{n}": close / F.lag("close", n).over(w) - 1 for n in (5, 10, 21)},
        "vol_10": rolling(F.stddev_samp, "_lr", 10),
        "vol_21": rolling(F.stddev_samp, "_lr", 21),
        "dist_sma21": close / rolling(F.avg, "close", 21) - 1,
        "rsi_14": F.when(F.col("_d").isNotNull(), 100 - 100 / (1 + ratio("_gain", "_loss"))),
        "fd_close": frac_diff(F.col("_lc")),
    }
    need = {k: v for k, v in made.items() if k in columns or (k == "vol_21" and "fd_vol21" in columns)}
    if "rsi_14" in need:
        df = ewm_sums(df, {"_gain": (at_least("_d", 0.0), 13 / 14), "_loss": (-at_most("_d", 0.0), 13 / 14)})
    df = df.withColumns(need)
    if "fd_vol21" in columns:
        df = df.withColumn("_v", F.last("vol_21", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        df = df.withColumn("fd_vol21", frac_diff(F.col("_v")))
    return df.select(*keep)


def with_ranks(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``{x}_rank`` within each date for every column given."""
    return df.withColumns({f"{x}_rank": pct_rank(x) for x in columns})


# ---- microstructure ----------------------------------------------------------------------------------------------


@shielded
def micro_features(panel: DataFrame, columns: tuple[str, ...] = MICRO) -> DataFrame:
    w = by_ticker()
    dollars = F.col("close") * F.col("volume")
    df = panel.withColumns({"_lr": log_return(), "_dp": F.col("close") - F.lag("close").over(w), "_dv": dollars})
    df = df.withColumns(
        {"_ill": F.abs("_lr") / nonzero("_dv"), "_dp1": F.lag("_dp").over(w), "_ldv": log("_dv")}
    )
    frame = w.rowsBetween(-20, 0)
    pairs = F.count(F.when(F.col("_dp").isNotNull() & F.col("_dp1").isNotNull(), 1)).over(frame)
    cov = F.when(pairs == 21, F.covar_samp("_dp", "_dp1").over(frame))
    made = {
        "amihud": log(nonzero(rolling(F.avg, "_ill", 21))),
        "roll_spread": 2 * root(at_least(-cov, 0.0)),
        "dollar_vol_z": ratio(F.col("_ldv") - rolling(F.avg, "_ldv", 63), rolling(F.stddev_samp, "_ldv", 63)),
        "turnover_accel": ratio(rolling(F.avg, "volume", 5), rolling(F.avg, "volume", 21)) - 1,
    }
    return df.withColumns({k: made[k] for k in columns}).select(*panel.columns, *columns)


# ---- regime ------------------------------------------------------------------------------------------------------


@shielded
def cusum_vol(panel: DataFrame, n: int = 63) -> DataFrame:
    """Largest |C(t) - C(t-j)| / sqrt(j) of cumulated standardised returns over the last ``n`` bars."""
    w = by_ticker()
    df = panel.withColumn("_lr", log_return())
    z = ratio(F.col("_lr") - rolling(F.avg, "_lr", n), rolling(F.stddev_samp, "_lr", n))
    df = df.withColumn("_z", z)
    df = df.withColumn("_c", F.sum(F.coalesce("_z", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    full = F.count("_z").over(w.rowsBetween(-(n - 1), 0)) == n
    stats = [F.abs(F.col("_c") - F.coalesce(F.lag("_c", j).over(w), F.lit(0.0))) / float(j) ** 0.5 for j in range(1, n + 1)]
    return df.withColumn("cusum_vol", F.when(full, F.greatest(*stats))).drop("_lr", "_z", "_c")


def _growth_statistic(y: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each bar the largest t statistic of the slope of dy on y(-1) over trailing windows of ``lengths`` pairs.

    The t statistic of a simple regression follows from the correlation r of the two columns alone,
    t = r * sqrt((n - 2) / (1 - r * r)). A table of running moments, one row a bar, is read at each window's two ends,
    so all lengths of a bar are one row of a bars x lengths matrix.
    """
    pairs = np.column_stack((y[:-1], np.diff(y)))
    missing = ~np.isfinite(pairs).all(axis=1)
    pairs[missing] = 0.0
    moments = np.column_stack((pairs, pairs[:, 0] ** 2, pairs[:, 1] ** 2, pairs[:, 0] * pairs[:, 1], missing))
    running = np.vstack((np.zeros(moments.shape[1]), moments.cumsum(axis=0)))
    begin = np.arange(len(y))[:, None] - lengths
    window = running[:, None, :] - running[np.maximum(begin, 0)]
    mean = window[..., :2] / lengths[:, None]
    spread = window[..., 2:4] / lengths[:, None] - mean**2
    joint = window[..., 4] / lengths - mean.prod(axis=-1)
    with np.errstate(invalid="ignore", divide="ignore"):
        r = joint / np.sqrt(spread.prod(axis=-1))
        t = r * np.sqrt((lengths - 2) / (1 - r * r))
    usable = (begin >= 0) & (window[..., 5] < 0.5) & (spread > 0).all(axis=-1) & (np.abs(r) < 1)
    return np.where(usable, t, -np.inf).max(axis=1)


@shielded
def explosivity(panel: DataFrame, low: int = 20, high: int = 80, at_once: int = 4096) -> DataFrame:
    """Largest t statistic of rho in dy = alpha + rho * y(-1) over trailing windows of ``low`` to ``high`` pairs.

    One ticker's closes are one Arrow group, worked on in runs of ``at_once`` bars: as a column expression the 61 windows
    exceed what the JVM compiles, and an interpreted plan takes some forty times as long. Each run's log prices start at
    0, which leaves the statistic unchanged and the sums well conditioned however long the history. Null where no window
    fits or none has a usable close; an empty panel gives no row.
    """
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in panel.schema.fields]
    lengths = np.arange(low, high + 1)

    def work(table):
        table = table.sort_by("date")
        with np.errstate(invalid="ignore", divide="ignore"):
            y = np.log(table.column("close").to_numpy().astype(np.float64))
        best = np.full(len(y), -np.inf)
        for start in range(0, len(y), at_once):
            first = max(0, start - high)
            run = y[first : start + at_once]
            known = run[np.isfinite(run)]
            best[start : start + at_once] = _growth_statistic(run - (known[0] if len(known) else 0.0), lengths)[start - first :]
        return table.append_column("explosivity", pa.array(best, pa.float64(), mask=~np.isfinite(best)))

    return panel.groupBy("ticker").applyInArrow(work, ", ".join([*fields, "explosivity double"]))


@shielded
def vol_regime(panel: DataFrame, short: int = 10, long: int = 63) -> DataFrame:
    df = panel.withColumn("_lr", log_return())
    made = ratio(rolling(F.stddev_samp, "_lr", short), rolling(F.stddev_samp, "_lr", long))
    return df.withColumn("vol_regime", made).drop("_lr")


def regime_features(panel: DataFrame) -> DataFrame:
    return vol_regime(explosivity(cusum_vol(panel)))


# ---- fundamentals ------------------------------------------------------------------------------------------------


@shielded
def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, order: list[str], columns: list[str]) -> DataFrame:
    """For each row of ``left`` the latest whole row of ``right`` with the same key and ``right_time <= left_time``.

    Both sides are stacked and a running ``last`` carries the right row forward: one shuffle and linear work, however
    many right rows a key has. Nulls inside the chosen row stay; rows equal in time rank by ``order``, last wins.
    """
    pack = F.struct(*[F.col(x).alias(x) for x in columns])
    r = right.select(F.col(key), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*order).alias("_o"), pack.alias("_r"))
    bare = left.withColumn("_l", F.struct(*left.columns)).select(F.col(key), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), "_l")
    both = bare.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return both.select("_l.*", *[F.col(f"_r.{x}").alias(x) for x in columns])


def fundamental_features(panel: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Factors known at each bar: from ``available``, not from the quarter's end."""
    cols = ["book_value", "trailing_eps", "profit_margin", "div_yield_raw"]
    joined = as_of(panel, fundamentals, "ticker", "date", "available", ["end_date"], cols)
    return joined.select(
        *panel.columns,
        ratio("trailing_eps", "close").alias("earnings_yield"),
        ratio("book_value", "close").alias("book_to_price"),
        "profit_margin",
        F.col("div_yield_raw").alias("div_yield"),
    )


# ---- assembled matrix --------------------------------------------------------------------------------------------

def _ranked(columns: tuple[str, ...]) -> tuple[str, ...]:
    return columns + tuple(f"{x}_rank" for x in columns)


_BLOCKS = {"price": PRICE, "amihud": ("amihud",), "micro": MICRO, "regime": REGIME, "fundamental": FUNDAMENTAL}
_SETS = ("price", "amihud_only", "price+amihud", "price+micro", "price+regime", "price+micro+regime", "micro+regime", "fundamental_only", "price+fundamental")


def feature_set(name: str) -> tuple[str, ...]:
    """Columns of a named set: blocks joined by +, each with its ranks; ``all`` has every block."""
    if name == "all":
        name = "price+micro+regime+fundamental"
    elif name not in _SETS:
        raise KeyError(name)
    return tuple(x for block in name.removesuffix("_only").split("+") for x in _ranked(_BLOCKS[block]))


FEATURE_SETS = (*_SETS, "all")


def feature_matrix(labeled: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """All blocks on one frame: per-ticker windows first, then ranks by date; no join between blocks."""
    df = price_features(labeled)
    df = regime_features(micro_features(df))  # the grouped step sits between window steps on the same key
    df = fundamental_features(df, fundamentals)
    return with_ranks(df, PRICE + MICRO + REGIME + FUNDAMENTAL)
