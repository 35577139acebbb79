"""Evaluation statistics: Sharpe ratios, moments, AUC, rank correlation, probabilistic and deflated Sharpe."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import average_rank, nonzero, shielded
from ..functions.normal import cdf, lit, ppf, with_ppf
from ..session import materialise

EULER = 0.5772156649015329


def sharpe(x: str) -> Column:
    """Mean over sample deviation, not annualised; null with fewer than two values or none that differ."""
    return F.when(F.count(x) >= 2, F.avg(x) / nonzero(F.stddev_samp(x)))


def skew(x: str) -> Column:
    """Bias-corrected skewness from Spark's population moment."""
    n = F.count(x).cast("double")
    return F.when((n >= 3) & (F.var_pop(x) > 0), F.skewness(x) * F.sqrt(n * (n - 1)) / nonzero(n - 2))


def kurt(x: str) -> Column:
    """Bias-corrected excess kurtosis."""
    n = F.count(x).cast("double")
    good = (n >= 4) & (F.var_pop(x) > 0)
    return F.when(good, (n - 1) / nonzero((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def summary(returns: DataFrame, x: str, *keys: str) -> DataFrame:
    """n, mean, Sharpe, skewness and kurtosis (3 for a normal) of a return column."""
    return returns.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), sharpe(x).alias("sharpe"), skew(x).alias("skew"), (kurt(x) + 3).alias("kurt")
    )


def dispersion(paths: DataFrame, x: str) -> DataFrame:
    """Spread over paths: population deviation, mean, extremes and the share above one half."""
    return paths.agg(
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("low"), F.max(x).alias("high"),
        F.avg((F.col(x) > 0.5).cast("double")).alias("above_half"),
    )


def t_stat(x: str) -> Column:
    return F.avg(x) / nonzero(F.stddev_samp(x) / F.sqrt(F.count(x).cast("double")))


def _under_sql(sr: str, skew: str, kurt: str) -> str:
    return f"({lit(1)} - ({skew}) * ({sr}) + (({kurt}) - {lit(1)}) / {lit(4)} * ({sr}) * ({sr}))"


def _z_sql(sr: str, bench: str, n: str, under: str) -> str:
    return f"((({sr}) - ({bench})) * sqrt(case when ({n}) > 1 then ({n}) - {lit(1)} end) / sqrt(case when {under} > {lit(0)} then {under} end))"


def psr_sql(sr: str, bench: str, n: str, skew: str = lit(0), kurt: str = lit(3)) -> str:
    """SQL text of the probabilistic Sharpe ratio."""
    z = _z_sql(sr, bench, n, _under_sql(sr, skew, kurt))
    return f"(case when {z} is not null then {cdf(z)} end)"


def _best_sql(var: str, first: str, second: str) -> str:
    return f"(sqrt({var}) * ({lit(1 - EULER)} * {first} + {lit(EULER)} * {second}))"


def _first_sql(n: str) -> str:
    return f"{lit(1)} - {lit(1)} / ({n})"


def _second_sql(n: str) -> str:
    return f"{lit(1)} - {lit(1)} / (({n}) * {lit(2.718281828459045)})"


def expected_best_sql(var: str, n: str) -> str:
    """SQL text of the expected best Sharpe of ``n`` null trials whose variance is ``var``."""
    return _best_sql(var, ppf(_first_sql(n)), ppf(_second_sql(n)))


@shielded
def probabilistic_sharpe(df: DataFrame, sr: str, n: str, bench: str = lit(0), skew: str = lit(0), kurt: str = lit(3), name: str = "psr") -> DataFrame:
    """:func:`psr_sql` by way of columns: as one text its parts are written out dozens of times, which the parser, the plan
    and the generated code then hold."""
    df = df.withColumn("_under", F.expr(_under_sql(sr, skew, kurt))).withColumn("_z", F.expr(_z_sql(sr, bench, n, "_under")))
    return df.withColumn(name, F.expr(f"case when _z is not null then {cdf('_z')} end")).drop("_under", "_z")


def deflated_sharpe(df: DataFrame, trials: DataFrame, sr: str, n: str, skew: str = lit(0), kurt: str = lit(3), name: str = "dsr") -> DataFrame:
    """PSR against the best Sharpe that as many null trials would show; null with fewer than two differing trials."""
    spread = trials.where("sharpe is not null and not isnan(sharpe)").agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.var_samp("sharpe").alias("_var")
    )
    some = "case when _n >= 2 then _n end"
    spread = spread.withColumns({"_first": F.expr(_first_sql(some)), "_second": F.expr(_second_sql(some))})
    spread = with_ppf(with_ppf(spread, "_first", "_first"), "_second", "_second")
    bench = f"(case when _n >= 2 and _var > 0 then {_best_sql('_var', '_first', '_second')} end)"
    spread = spread.withColumn("sr_star", F.expr(bench)).withColumn("_k", F.lit(1))
    both = df.withColumn("_k", F.lit(1)).join(F.broadcast(spread), "_k").drop("_k", "_n", "_var", "_first", "_second")  # one row
    return probabilistic_sharpe(both, sr, n, "sr_star", skew, kurt, name)


def psr_value(sr: float, bench: float, n: float, skew: float = 0.0, kurt: float = 3.0) -> float | None:
    """The same for driver-side numbers."""
    under = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    return NormalDist().cdf((sr - bench) * (n - 1) ** 0.5 / under**0.5) if n >= 2 and under > 0 else None


def _edges(df: DataFrame, x: str, buckets: int = 256) -> list[float]:
    """Rough quantiles of ``x``, at most ``buckets`` numbers: they part the work and leave results unchanged."""
    places = F.array(*[F.lit(k / buckets) for k in range(1, buckets)])
    return sorted(set(df.agg(F.percentile_approx(x, places, F.lit(1000))).first()[0] or []))


@shielded
def auc(scored: DataFrame, score: str = "score", label: str = "label", *keys: str) -> DataFrame:
    """Area under the ROC curve, ties one half, for each of ``keys`` or for the whole table: auc and n.

    Rows fold into one for each distinct score. Those are summed up inside ranges of the score and the ranges' totals
    (a few hundred rows a key) after that, so no task sorts the table, with keys or without. Rows without a score or a
    label are left out; a key with one class only has no auc; without any row there is a row without auc only where no
    keys are asked for.
    """
    known = scored.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull())
    known = known.select(*keys, F.col(score).cast("double").alias("_x"), F.col(label).cast("long").alias("_y"))
    edges = F.array(*[F.lit(e) for e in _edges(known, "_x")]).cast("array<double>")
    each = known.groupBy(*keys, "_x").agg(F.sum("_y").alias("_n1"), F.sum(1 - F.col("_y")).alias("_n0"))
    each = each.withColumn("_range", F.size(F.filter(edges, lambda e: e < F.col("_x"))))
    below = Window.partitionBy(*keys, "_range").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("_under", F.coalesce(F.sum("_n0").over(below), F.lit(0)))
    ranges = each.groupBy(*keys, "_range").agg(
        F.sum(F.col("_n1") * (F.col("_under") + F.col("_n0") / 2)).alias("_wins"), F.sum("_n1").alias("_n1"), F.sum("_n0").alias("_n0")
    )
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_under", F.coalesce(F.sum("_n0").over(before), F.lit(0)))
    n1, n0 = F.sum("_n1").cast("double"), F.sum("_n0").cast("double")
    wins = F.sum(F.col("_wins") + F.col("_n1") * F.col("_under"))
    return ranges.groupBy(*keys).agg((wins / nonzero(n1 * n0)).alias("auc"), F.coalesce(F.sum(F.col("_n1") + F.col("_n0")), F.lit(0)).alias("n"))


def accuracy(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    return scored.agg(
        F.avg(((F.col(score) >= 0.5).cast("int") == F.col(label)).cast("double")).alias("accuracy"), F.avg(F.col(label).cast("double")).alias("base_rate")
    )


@shielded
def rank_ic(scored: DataFrame, score: str, target: str, least: int = 12, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, date, ic, n): correlation of average ranks on dates with at least ``least`` names."""
    df = scored.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    df = df.withColumns({"_a": average_rank(score, *by, "date"), "_b": average_rank(target, *by, "date")})
    # not F.corr: it fails where all scores of a date tie
    ic = F.covar_pop("_a", "_b") / nonzero(F.stddev_pop("_a") * F.stddev_pop("_b"))
    out = df.groupBy(*by, "date").agg(ic.alias("ic"), F.count(F.lit(1)).alias("n"))
    return out.where((F.col("n") >= least) & F.col("ic").isNotNull())


@shielded
def relevance(df: DataFrame, x: str, buckets: int = 5, *keys: str) -> DataFrame:
    """Equal-count bucket of ``x`` (ties by ticker and date): edges are linear quantiles of the ranks 1..n.

    Ranks count within each of ``keys``; without keys the table is written in ranges of (x, ticker, date), ranked inside
    each range and moved up by the rows of the ranges before, so no task sorts it whole. Rows with a null ``x`` go.
    """
    rows, order = df.where(F.col(x).isNotNull()), [x, "ticker", "date"]
    if keys:
        w = Window.partitionBy(*keys)
        rows = rows.withColumns({"_r": F.row_number().over(w.orderBy(*order)), "_n": F.count(F.lit(1)).over(w)})
    else:
        rows = materialise(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
        held = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_held"))
        upto = F.sum("_held").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
        held = held.withColumns({"_before": upto - F.col("_held"), "_n": F.sum("_held").over(Window.partitionBy(F.lit(0)))}).drop("_held")
        inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
        rows = rows.withColumn("_r", inside).join(F.broadcast(held), "_range")  # one row a shuffle partition
        rows = rows.withColumn("_r", F.col("_r") + F.col("_before")).drop("_range", "_before")
    # bucket b holds ranks in (1 + b(n-1)/k, 1 + (b+1)(n-1)/k]; the first takes rank 1 too
    place = F.ceil((F.col("_r") - 1) * F.lit(buckets) / nonzero(F.col("_n") - 1)) - 1
    return rows.withColumn("relevance", F.greatest(F.coalesce(place, F.lit(0)), F.lit(0)).cast("int")).drop("_r", "_n")
