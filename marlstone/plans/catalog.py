"""The registered panel queries. Computed doubles are rounded in the last projection only, as in their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import at_most, beside, impact_bps, net_of_costs, round_trip_bps
from ..functions.normal import lit
from ..operators import book as books
from ..operators import features as fx
from ..operators import labels as lb
from ..operators import models, panel, stats, trials, validation
from ..operators.boosting import Boosted
from ..session import materialise
from ..sources import readers
from . import derived as d

DIGITS = 6
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str, digits: int = DIGITS) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in columns])


def feature(name: str, build, *columns: str):
    def run(spark, sf_dir):
        return rounded(build(d.bars(spark, sf_dir)), "ticker", "date", *columns)

    run.__name__ = name
    return query(run)


def score(df: DataFrame) -> DataFrame:
    """A fixed score for evaluation queries: the rank of 21-bar momentum within its date."""
    return fx.with_ranks(fx.price_features(df, ("mom_21",)), ("mom_21",)).withColumnRenamed("mom_21_rank", "score")


def labeled_score(spark, sf_dir) -> DataFrame:
    return score(lb.triple_barrier(d.bars(spark, sf_dir))).where("score is not null and label is not null")


# ---- panel ---------------------------------------------------------------------------------------------------------


@query
def panel_bars(spark, sf_dir):
    return d.bars(spark, sf_dir, True).select("ticker", "date", "open", "high", "low", "close", "volume")


@query
def tr_adjust(spark, sf_dir):
    p = panel.adjust_total_return(d.raw_panel(spark, sf_dir))
    return rounded(p, "ticker", "date", "open", "high", "low", "close", "volume", digits=9)


@query
def panel_filters(spark, sf_dir):
    p = panel.with_min_bars(d.bars(spark, sf_dir), 300)
    p = panel.between_dates(panel.in_universe(p, ["Brand#11"], keep=False), "1993-01-01", "1997-12-31")
    return p.select("ticker", "date", "close", "volume")


@query
def panel_coverage(spark, sf_dir):
    return panel.coverage(d.bars(spark, sf_dir))


@query
def panel_dedup(spark, sf_dir):
    t = d.trades(spark, sf_dir)
    one = panel.first_of_each(t, ["ticker", "date"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return one.select("ticker", "date", "l_orderkey", "l_linenumber", "l_extendedprice")


@query
def missing_tickers(spark, sf_dir):
    """The listing holds every brand and every part type; only brands have bars."""
    part = d.table(spark, sf_dir, "part")
    listed = part.select(F.explode(F.array("p_brand", "p_type")).alias("ticker")).distinct()
    return panel.missing_tickers(d.bars(spark, sf_dir), listed)


@query
def universe_select(spark, sf_dir):
    return panel.select_universe(d.stocks(spark, sf_dir), 120, 1e6).select("ticker", "adv", "market_cap")


@query
def adjustment_factor(spark, sf_dir):
    return panel.adjustment_factor(d.bars(spark, sf_dir), d.corporate_events(spark, sf_dir)).select("ticker", "date", "factor")


@query
def factor_check(spark, sf_dir):
    f = panel.adjustment_factor(d.bars(spark, sf_dir), d.corporate_events(spark, sf_dir))
    return panel.never_falls(f)


@query
def reference_difference(spark, sf_dir):
    f = panel.adjustment_factor(d.bars(spark, sf_dir), d.corporate_events(spark, sf_dir))
    adjusted = f.withColumn("close", F.col("close") * F.col("factor"))
    ref = d.raw_panel(spark, sf_dir).withColumn("close", F.col("adjustedClose"))
    return panel.reference_difference(adjusted, ref).select("ticker", "date", "pct_diff")


# ---- features ------------------------------------------------------------------------------------------------------

feature("momentum", lambda p: fx.price_features(p, ("mom_5", "mom_10", "mom_21")), "mom_5", "mom_10", "mom_21")
feature("rolling_vol", lambda p: fx.price_features(p, ("vol_10", "vol_21")), "vol_10", "vol_21")
feature("dist_sma", lambda p: fx.price_features(p, ("dist_sma21",)), "dist_sma21")
feature("ewm_vol", fx.daily_vol, "sigma")
feature("rsi", lambda p: fx.price_features(p, ("rsi_14",)), "rsi_14")
feature("fracdiff_close", lambda p: fx.price_features(p, ("fd_close",)), "fd_close")
feature("fracdiff_vol", lambda p: fx.price_features(p, ("fd_vol21",)), "fd_vol21")
feature("amihud", lambda p: fx.micro_features(p, ("amihud",)), "amihud")
feature("roll_spread", lambda p: fx.micro_features(p, ("roll_spread",)), "roll_spread")
feature("dollar_vol_z", lambda p: fx.micro_features(p, ("dollar_vol_z",)), "dollar_vol_z")
feature("turnover_accel", lambda p: fx.micro_features(p, ("turnover_accel",)), "turnover_accel")
feature("cusum_vol", fx.cusum_vol, "cusum_vol")
feature("explosivity", fx.explosivity, "explosivity")
feature("vol_regime", fx.vol_regime, "vol_regime")
feature("forward_return", lb.forward_return, "fwd")
feature("cs_pct_rank", lambda p: fx.with_ranks(fx.price_features(p, ("mom_5", "mom_21")), ("mom_5", "mom_21")), "mom_5_rank", "mom_21_rank")


@query
def fundamentals_long(spark, sf_dir):
    f = d.fundamentals(spark, sf_dir)
    return rounded(f, *f.columns)


@query
def asof_fundamentals(spark, sf_dir):
    cols = ["end_date", "book_value", "trailing_eps", "profit_margin", "div_yield_raw"]
    got = fx.as_of(d.bars(spark, sf_dir).select("ticker", "date"), d.fundamentals(spark, sf_dir), "ticker", "date", "available", ["end_date"], cols)
    return rounded(got, "ticker", "date", *cols)


@query
def fund_factors(spark, sf_dir):
    return rounded(fx.fundamental_features(d.bars(spark, sf_dir), d.fundamentals(spark, sf_dir)), "ticker", "date", *fx.FUNDAMENTAL)


@query
def feature_matrix(spark, sf_dir):
    m = fx.feature_matrix(lb.triple_barrier(d.bars(spark, sf_dir)), d.fundamentals(spark, sf_dir))
    m = m.withColumn("label", F.col("label").cast("double"))
    return rounded(m, "ticker", "date", "label", "fd_close", "fd_vol21", "rsi_14", "mom_21", *fx.MICRO, *fx.REGIME, *fx.FUNDAMENTAL, "mom_5_rank", "mom_21_rank")


# ---- labels and weights ----------------------------------------------------------------------------------------------


@query
def triple_barrier(spark, sf_dir):
    t = lb.triple_barrier(d.bars(spark, sf_dir)).withColumn("label", F.col("label").cast("double"))
    return rounded(t, "ticker", "date", "sigma", "label", "barrier", "fwd_ret", "t1")


@query
def concurrency(spark, sf_dir):
    return lb.concurrency(lb.triple_barrier(d.bars(spark, sf_dir))).select("ticker", "date", F.col("conc").cast("long").alias("conc"))


@query
def avg_uniqueness(spark, sf_dir):
    return rounded(lb.average_uniqueness(lb.triple_barrier(d.bars(spark, sf_dir))), "ticker", "date", "uniq")


@query
def return_attr_weights(spark, sf_dir):
    return rounded(lb.return_attribution(lb.triple_barrier(d.bars(spark, sf_dir))), "ticker", "date", "attr")


@query
def time_decay(spark, sf_dir):
    w = lb.average_uniqueness(lb.triple_barrier(d.bars(spark, sf_dir))).where("uniq is not null")
    w = lb.time_decay(lb.time_decay(w, "uniq", 0.5, "half"), "uniq", -0.5, "cut")
    return rounded(w, "ticker", "date", "half", "cut")


@query
def panel_weights(spark, sf_dir):
    return rounded(lb.sample_weights(lb.triple_barrier(d.bars(spark, sf_dir)), "uniqueness"), "ticker", "date", "w")


@query
def indicator_matrix(spark, sf_dir):
    m = lb.indicator_matrix(lb.triple_barrier(d.bars(spark, sf_dir)))
    return m.groupBy("ticker", "bar_idx").agg(F.count(F.lit(1)).alias("labels"), F.sum(F.col("label_idx").cast("long")).alias("label_sum"))


# ---- validation ------------------------------------------------------------------------------------------------------


@query
def cpcv_blocks(spark, sf_dir):
    b = validation.blocks(d.bars(spark, sf_dir))
    return b.select("date", F.col("pos").cast("long").alias("pos"), F.col("block").cast("long").alias("block"))


@query
def cpcv_roles(spark, sf_dir):
    r = validation.roles(lb.triple_barrier(d.bars(spark, sf_dir)).where("t1 is not null").select("ticker", "date", "t1"))
    day = F.unix_date("date").cast("long")
    return r.groupBy(F.col("split_id").cast("long").alias("split_id"), "ticker", "role").agg(F.count(F.lit(1)).alias("n"), F.sum(day).alias("day_sum"))


@query
def purged_split(spark, sf_dir):
    r = validation.temporal_split(d.bars(spark, sf_dir))
    return r.groupBy("ticker", "role").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query
def meta_split(spark, sf_dir):
    r = validation.meta_split(lb.triple_barrier(d.bars(spark, sf_dir)).where("t1 is not null"))
    return r.groupBy("ticker", "role").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query
def effective_n(spark, sf_dir):
    return validation.effective_n(d.bars(spark, sf_dir))


# ---- books and evaluation --------------------------------------------------------------------------------------------


@query
def median_adv(spark, sf_dir):
    return rounded(books.median_adv(d.bars(spark, sf_dir)), "ticker", "adv", digits=4)


@query
def ls_sensor(spark, sf_dir):
    return rounded(books.long_short_sensor(labeled_score(spark, sf_dir)), "date", "ls")


@query
def sized_ls(spark, sf_dir):
    s = labeled_score(spark, sf_dir).withColumn("size", F.col("score") - 0.5)
    return rounded(books.sized_long_short(s), "date", "ls")


def _tercile(spark, sf_dir):
    p = lb.forward_return(score(d.bars(spark, sf_dir)), 63, "fwd_ret")
    on = books.on_stride(p, 63).where("score is not null and fwd_ret is not null")
    return p, books.book(on, 1 / 3, 2 / 3, 12)


@query
def tercile_book(spark, sf_dir):
    held = _tercile(spark, sf_dir)[1]
    return rounded(held.withColumn("k", F.col("k").cast("long")), "k", "date", "ticker", "w", "ret")


@query
def turnover(spark, sf_dir):
    return rounded(books.turnover(_tercile(spark, sf_dir)[1]).withColumn("k", F.col("k").cast("long")), "k", "turnover")


@query
def tercile_costed(spark, sf_dir):
    p, held = _tercile(spark, sf_dir)
    out = books.costed(held, books.median_adv(p), 2e6, 5.0)
    return rounded(out, "date", "gross", "cost", "net", "turnover")


@query
def costed_backtest(spark, sf_dir):
    s = labeled_score(spark, sf_dir)
    return rounded(books.costed_backtest(s, books.median_adv(d.bars(spark, sf_dir))), "date", "gross", "cost", "net", "turnover")


@query
def fundamental_tilt(spark, sf_dir):
    return rounded(books.fundamental_tilt(d.bars(spark, sf_dir), d.fundamentals(spark, sf_dir)), "date", "gross", "cost", "net", "turnover")


@query
def cost_functions(spark, sf_dir):
    o = d.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1e7 - 0.001).alias("p"))
    ret, turned = F.lit(0.01), at_most(F.col("p") * 10, 1.0)
    return rounded(
        o.select("o_orderkey", impact_bps(F.col("p"), 0.02).alias("impact"), round_trip_bps(F.col("p"), 0.02).alias("round_trip"), net_of_costs(ret, turned, F.col("p"), 0.02).alias("net")),
        "o_orderkey", "impact", "round_trip", "net",
    )


@query
def sharpe_summary(spark, sf_dir):
    return rounded(stats.summary(books.long_short_sensor(labeled_score(spark, sf_dir)), "ls"), "n", "mean", "sharpe", "skew", "kurt")


@query
def psr(spark, sf_dir):
    s = stats.summary(books.long_short_sensor(labeled_score(spark, sf_dir)), "ls").withColumn("nd", F.col("n").cast("double"))
    return rounded(stats.probabilistic_sharpe(s, "sharpe", "nd", lit(0), "skew", "kurt"), "n", "psr")


@query
def dsr(spark, sf_dir):
    s = stats.summary(books.long_short_sensor(labeled_score(spark, sf_dir)), "ls").withColumn("nd", F.col("n").cast("double"))
    log = spark.createDataFrame(trials.SEEDS, trials.SCHEMA)
    return rounded(stats.deflated_sharpe(s, log, "sharpe", "nd"), "n", "sr_star", "dsr")


@query
def path_dispersion(spark, sf_dir):
    per = stats.auc(labeled_score(spark, sf_dir), "score", "label", "ticker")
    return rounded(stats.dispersion(per, "auc"), "mean", "std", "low", "high", "above_half")


@query
def auc_mann_whitney(spark, sf_dir):
    return rounded(stats.auc(labeled_score(spark, sf_dir)), "auc", "n")


@query
def mean_t_stat(spark, sf_dir):
    per = stats.auc(labeled_score(spark, sf_dir), "score", "label", "ticker")
    return per.agg(F.round(stats.t_stat("auc"), 6).alias("t"), F.count("auc").alias("n"))


@query
def accuracy(spark, sf_dir):
    return rounded(stats.accuracy(labeled_score(spark, sf_dir)), "accuracy", "base_rate")


@query
def spearman_ic(spark, sf_dir):
    return rounded(stats.rank_ic(labeled_score(spark, sf_dir), "score", "fwd_ret"), "date", "ic", "n")


@query
def relevance_qcut(spark, sf_dir):
    r = stats.relevance(lb.forward_return(d.bars(spark, sf_dir)), "fwd", 5, "date")
    return r.select("ticker", "date", F.col("relevance").cast("long").alias("relevance"))


@query
def trials_upsert(spark, sf_dir):
    log = trials.seed(spark.createDataFrame([("L0", 0.5)], trials.SCHEMA), spark.createDataFrame(trials.SEEDS, trials.SCHEMA))
    new = d.table(spark, sf_dir, "nation").select(F.concat(F.lit("L"), F.col("n_nationkey").cast("string")).alias("name"), (F.col("n_regionkey") / 10.0).alias("sharpe"))
    return trials.append(log, new.where("name in ('L2', 'L3', 'L7')"))


# ---- sources ---------------------------------------------------------------------------------------------------------


@query
def fixed_width_scan(spark, sf_dir):
    b = d.bars(spark, sf_dir, True)
    return readers.fixed_width(readers.render_fixed_width(b)).select("ticker", "date", "close", "volume")


@query
def json_scan(spark, sf_dir):
    b = d.bars(spark, sf_dir, True).withColumn("adjustedClose", F.col("close"))
    bar = F.struct(F.unix_timestamp(F.col("date").cast("timestamp")).alias("date"), "open", "high", "low", "close", "adjustedClose", "volume")
    one = b.groupBy("ticker").agg(F.collect_list(bar).alias("historicalDataPrice"))
    inner = F.to_json(F.struct(F.array(F.struct(F.col("ticker").alias("symbol"), "historicalDataPrice")).alias("results")))
    text = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.lit("note").alias("text")), F.struct(F.lit("text").alias("type"), inner.alias("text"))))
    return readers.price_envelope(one.select(text.alias("value"))).select("ticker", "date", "close", "volume")


@query
def rest_scan(spark, sf_dir):
    b = d.bars(spark, sf_dir, True).withColumn("adjustedClose", F.col("close"))
    bar = F.struct(F.unix_timestamp(F.col("date").cast("timestamp")).alias("date"), "open", "high", "low", "close", "adjustedClose", "volume")
    one = b.groupBy("ticker").agg(F.collect_list(bar).alias("historicalDataPrice"))
    text = F.to_json(F.struct(F.col("ticker").alias("symbol"), "historicalDataPrice"))
    return readers.price_rest(one.select(text.alias("value"))).select("ticker", "date", "open", "close", "volume")


@query
def event_props(spark, sf_dir):
    e = d.table(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k int")["k"].cast("long").alias("k"))


# ---- cross-validated evaluation --------------------------------------------------------------------------------------


def _by_momentum(train, test):
    """A scorer that learns nothing: its results have SQL."""
    return test.withColumn("score", F.col("mom_21_rank"))


def _evaluated(spark, sf_dir):
    data = materialise(labeled_score(spark, sf_dir).withColumnRenamed("score", "mom_21_rank").select("ticker", "date", "t1", "label", "fwd_ret", "mom_21_rank"), "evaluated")
    return models.split_scores(data, _by_momentum, learns=False)


@query
def cpcv_results(spark, sf_dir):
    adv = materialise(books.median_adv(d.bars(spark, sf_dir)), "adv")
    out = models.split_results(_evaluated(spark, sf_dir), adv).withColumn("split_id", F.col("split_id").cast("long"))
    return rounded(out, "split_id", "auc", "n", "sharpe", "sharpe_gross", "sharpe_net", "rebalances")


@query
def cpcv_evaluation(spark, sf_dir):
    scored = _evaluated(spark, sf_dir)
    results = models.split_results(scored, materialise(books.median_adv(d.bars(spark, sf_dir)), "adv"))
    out, _ = models.evaluation(scored, results, spark.createDataFrame([], trials.SCHEMA), "momentum", learns=False)
    return rounded(out, "config", "auc", "auc_std", "auc_low", "auc_high", "above_half", "sharpe", "sharpe_std", "sharpe_gross", "sharpe_net", "splits", "skew", "kurt", "n_eff", "trials", "dsr")


@query
def tilt_summary(spark, sf_dir):
    got = materialise(books.fundamental_tilt(d.bars(spark, sf_dir), d.fundamentals(spark, sf_dir)), "tilt")
    run = got.agg(F.lit("fundamental_tilt_quarterly").alias("name"), stats.sharpe("net").alias("sharpe")).where("sharpe is not null")
    log = trials.append(spark.createDataFrame(trials.SEEDS, trials.SCHEMA), run)
    return rounded(books.tilt_summary(got, log), "rebalances", "sharpe_gross", "sharpe_net", "annualised", "psr", "dsr", "success")


# ---- models (no SQL) ---------------------------------------------------------------------------------------------------


def _weighted(spark, sf_dir):
    """Labels and, joined on (ticker, date), their uniqueness weights; a row without a weight counts 0."""
    labeled = materialise(lb.triple_barrier(d.bars(spark, sf_dir)), "labeled")
    w = lb.sample_weights(labeled, "uniqueness").select("ticker", "date", "w")
    return materialise(panel.with_default(labeled, w, ["ticker", "date"], "w", 0.0), "weighted")


def _model_data(spark, sf_dir, columns):
    rows = fx.with_ranks(fx.price_features(_weighted(spark, sf_dir)), fx.PRICE)
    rows = materialise(rows.select("ticker", "date", "t1", "label", "fwd_ret", "w", *columns), "features")
    return materialise(panel.complete_cases(rows, [*columns, "label", "t1"]), "model-data")


@query
def gbt_cpcv(spark, sf_dir):
    cols = fx.feature_set("price")
    return models.evaluate(_model_data(spark, sf_dir, cols), Boosted(cols, weight="w"), materialise(books.median_adv(d.bars(spark, sf_dir)), "adv"))


@query
def single_split(spark, sf_dir):
    cols = fx.PRICE
    result, gains = models.single_split(_model_data(spark, sf_dir, cols), Boosted(cols))
    top = spark.createDataFrame([(i + 1, f, g) for i, (f, g) in enumerate(gains.items())], "place int, feature string, gain double")
    return beside(top, result)


@query
def meta_sizing(spark, sf_dir):
    cols = fx.feature_set("price")
    return models.meta_labelled(_model_data(spark, sf_dir, cols), Boosted(cols))


@query
def ablation(spark, sf_dir):
    sets = {name: fx.feature_set(name) for name in fx.FEATURE_SETS}
    m = fx.feature_matrix(_weighted(spark, sf_dir), d.fundamentals(spark, sf_dir))
    data = materialise(m.select("ticker", "date", "t1", "label", "fwd_ret", "w", *sets["all"]), "model-data")
    adv = materialise(books.median_adv(d.bars(spark, sf_dir)), "adv")
    return models.ablation(data, sets, adv, spark.createDataFrame([], trials.SCHEMA), Boosted((), weight="w"))[0]


def _quarterly(spark, sf_dir):
    """Complete rows of rebalance dates: the ranker's columns, the return to the next rebalance, and t1, the row's own
    date, as a holding resolves at the next rebalance and the embargo covers it."""
    f = fx.fundamental_features(d.bars(spark, sf_dir), d.fundamentals(spark, sf_dir))
    f = fx.with_ranks(fx.price_features(f, ("mom_21", "vol_21")), ("mom_21", "vol_21"))
    cols = ("mom_21", "mom_21_rank", "vol_21", "vol_21_rank", *fx.FUNDAMENTAL)
    q = panel.complete_cases(books.on_stride(lb.forward_return(f, 63, "fwd_ret"), 63), [*cols, "fwd_ret"])
    return q.select("ticker", "date", F.col("date").alias("t1"), "fwd_ret", *cols), cols


@query
def quarterly_panel(spark, sf_dir):
    q, cols = _quarterly(spark, sf_dir)
    return rounded(q, "ticker", "date", "fwd_ret", *cols)


@query
def ranker(spark, sf_dir):
    q, cols = _quarterly(spark, sf_dir)
    return models.ranked(materialise(q, "ranker-data"), cols, materialise(books.median_adv(d.bars(spark, sf_dir)), "adv"))


@query
def sequential_bootstrap(spark, sf_dir):
    return models.sequential_bootstrap(lb.triple_barrier(d.bars(spark, sf_dir)))


@query
def min_ffd_d(spark, sf_dir):
    return models.min_ffd_d(d.bars(spark, sf_dir), thresh=1e-3)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return {k: v for k, v in ORACLES.items() if k in QUERIES}


