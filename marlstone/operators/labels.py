"""First-touch barrier labels and forward returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.columns import beside, by_ticker, shielded
from ..session import materialise
from .features import daily_vol


@shielded
def triple_barrier(panel: DataFrame, pt: float = DEFAULT.pt_mult, sl: float = DEFAULT.sl_mult, horizon: int = DEFAULT.horizon, span: int = DEFAULT.vol_span) -> DataFrame:
    """Adds sigma, label, barrier, fwd_ret, t1, res_idx and idx.

    The next ``horizon`` bars are gathered in one window; the first that touches a barrier resolves the label. A bar
    that touches both counts as a stop; without a touch the label resolves at the last bar seen. The bar's own deviation
    must be known and positive, and the ticker's last bar has no label. A null high or low touches nothing; columns of
    these names are replaced; an empty panel gives no row.
    """
    w = by_ticker()
    ahead = w.rowsBetween(1, horizon)
    df = daily_vol(panel, span)
    df = df.withColumns({
        "idx": F.row_number().over(w),
        "_next": F.collect_list(F.struct("high", "low", "close", "date")).over(ahead),
    })
    up, down = F.col("close") * (1 + pt * F.col("sigma")), F.col("close") * (1 - sl * F.col("sigma"))
    hit = F.array_position(F.transform("_next", lambda x: (x["high"] >= up) | (x["low"] <= down)), True)
    df = df.withColumn("_hit", hit).withColumn("_at", F.when(F.col("_hit") > 0, F.col("_hit")).otherwise(F.size("_next")).cast("int"))
    df = df.withColumn("_bar", F.when((F.col("sigma") > 0) & (F.col("_at") > 0), F.try_element_at("_next", "_at")))
    high, low = F.col("_bar.high") >= up, F.col("_bar.low") <= down
    barrier = F.when(F.col("_hit") == 0, "vert").when(high & low, "both->sl").when(high, "pt").otherwise("sl")
    known = F.col("_bar").isNotNull()
    return df.withColumns({
        "barrier": F.when(known, barrier),
        "label": F.when(known, ((F.col("_hit") > 0) & high & ~low).cast("int")),
        "fwd_ret": F.col("_bar.close") / F.col("close") - 1,
        "t1": F.col("_bar.date"),
        "res_idx": F.when(known, F.col("idx") + F.col("_at")),
    }).drop("_next", "_hit", "_at", "_bar")


def forward_return(panel: DataFrame, n: int = DEFAULT.rebalance, name: str = "fwd") -> DataFrame:
    """Return over the ticker's own next ``n`` bars."""
    return panel.withColumn(name, F.lead("close", n).over(by_ticker()) / F.col("close") - 1)


# ---- sample weights ----------------------------------------------------------------------------------------------


def _marked(df: DataFrame, *marks: Column) -> DataFrame:
    """Each row once for every mark (a struct with pos) that is not null, in column _m: no second pass over the input,
    and rows of a ticker stay where they are."""
    return df.withColumn("_m", F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull())))


@shielded
def concurrency(labeled: DataFrame) -> DataFrame:
    """``conc``: labels whose interval [idx, res_idx] covers the bar.

    A label steps up at its own bar and down after the one it resolves at; the steps are laid among the bars and summed
    up in one window, so no bar is joined to labels. Rows without a label count nothing; an empty panel gives no row.
    """
    known = F.col("res_idx").isNotNull()
    mark = lambda pos, bar, step: F.struct(pos.cast("long").alias("pos"), F.lit(bar).alias("bar"), step.cast("long").alias("step"))
    rows = _marked(labeled, mark(F.col("idx"), 1, known.cast("int")), F.when(known, mark(F.col("res_idx") + 1, 0, F.lit(-1))))
    run = Window.partitionBy("ticker").orderBy("_m.pos", "_m.bar").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("conc", F.sum("_m.step").over(run)).where("_m.bar = 1").drop("_m")


def _over_interval(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``name``: sum of ``value`` over [idx, res_idx], the difference of prefix sums at both ends.

    Each label asks for the sum at its end by a mark laid after that bar: one window more instead of a self-join.
    """
    run = Window.partitionBy("ticker").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_v", F.coalesce(value, F.lit(0.0))).withColumn("_p", F.sum("_v").over(run))
    known = F.col("res_idx").isNotNull()
    mark = lambda pos, asks: F.struct(pos.cast("long").alias("pos"), F.lit(asks).alias("asks"))
    rows = _marked(df, mark(F.col("idx"), 0), F.when(known, mark(F.col("res_idx"), 1)))
    upto = Window.partitionBy("ticker").orderBy("_m.pos", "_m.asks").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_q", F.last(F.when(F.col("_m.asks") == 0, F.col("_p")), ignorenulls=True).over(upto))
    rows = rows.where((F.col("_m.asks") == 1) | ~known)
    return rows.withColumn(name, F.when(known, F.col("_q") - F.col("_p") + F.col("_v"))).drop("_m", "_p", "_q", "_v")


@shielded
def average_uniqueness(labeled: DataFrame) -> DataFrame:
    """``uniq``: mean of 1/concurrency over the label's interval; null without a label."""
    df = concurrency(labeled)
    df = _over_interval(df, 1.0 / F.nullif("conc", F.lit(0)), "_sum")
    return df.withColumn("uniq", F.col("_sum") / (F.col("res_idx") - F.col("idx") + 1)).drop("_sum")


@shielded
def return_attribution(labeled: DataFrame) -> DataFrame:
    """``attr``: |sum of log returns shared by concurrency| over the label's interval."""
    df = concurrency(labeled)
    lr = F.ln(F.col("close") / F.lag("close").over(by_ticker()))
    df = df.withColumn("_lr", lr)
    df = _over_interval(df, F.col("_lr") / F.nullif("conc", F.lit(0)), "_sum")
    return df.withColumn("attr", F.abs("_sum")).drop("_sum", "_lr")


def time_decay(df: DataFrame, weight: str, last_w: float = 1.0, name: str = "decayed") -> DataFrame:
    """Linear decay in cumulated weight: the newest keeps its weight, the oldest gets ``last_w`` of it (cut below 0)."""
    run = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("ticker")
    total = F.sum(weight).over(whole)
    slope = (1.0 - last_w) / F.nullif(total, F.lit(0.0)) if last_w >= 0 else 1.0 / F.nullif((last_w + 1.0) * total, F.lit(0.0))
    decay = 1.0 - slope * total + slope * F.sum(weight).over(run)
    return df.withColumn(name, F.col(weight) * F.greatest(decay, F.lit(0.0)))


@shielded
def sample_weights(labeled: DataFrame, mode: str = "return_attr", decay: float | None = None) -> DataFrame:
    """``w``: weights with mean 1 over the positive ones; 0 without a label. Without a positive one they stay 0."""
    df, raw = (average_uniqueness(labeled), "uniq") if mode == "uniqueness" else (return_attribution(labeled), "attr")
    if decay is not None:
        df = time_decay(df, raw, decay, "_d")
        raw = "_d"
    df = materialise(df.withColumn("_w", F.coalesce(raw, F.lit(0.0))), "raw-weights")  # read twice: for the mean and the result
    mean = df.agg(F.avg(F.when(F.col("_w") > 0, F.col("_w"))).alias("_mean"))
    out = beside(df, mean)
    return out.withColumn("w", F.when(F.col("_mean") > 0, F.col("_w") / F.col("_mean")).otherwise(F.col("_w"))).drop("_w", "_mean", "_d")


def indicator_matrix(labeled: DataFrame) -> DataFrame:
    """Sparse (ticker, bar idx, label idx): one row for each bar that a label's interval covers."""
    own = labeled.where("res_idx is not null")
    return own.select("ticker", F.col("idx").alias("label_idx"), F.explode(F.sequence("idx", "res_idx")).alias("bar_idx"))
