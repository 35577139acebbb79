import datetime as dt
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.functions import columns as C
from marlstone.functions.normal import cdf, ppf
from marlstone.operators import book, labels, models, panel, stats, trials, validation
from marlstone.operators import features as fx
from marlstone.sources import readers

DAYS = [d.date() for d in pd.bdate_range("2020-01-01", periods=420)]


def bars(spark, close, ticker="AAA0", high=None, low=None, volume=1e6):
    rows = [
        (ticker, DAYS[i], float(c), float((high or {}).get(i, c)), float((low or {}).get(i, c)), float(volume)) for i, c in enumerate(close)
    ]
    return spark.createDataFrame(rows, "ticker string, date date, close double, high double, low double, volume double")


def pdf(df, *order):
    return df.orderBy(*order).toPandas()


def wobble(n):
    return [100 * (1 + 0.004 * (-1) ** i) for i in range(n)]


# ---- labels ----------------------------------------------------------------------------------------------------------


def test_profit_take_resolves_at_the_touching_bar(spark):
    close = wobble(40)
    got = pdf(labels.triple_barrier(bars(spark, close, high={25: close[25] * 1.5})), "date")
    row = got.iloc[20]
    assert (row.barrier, row.label, row.t1) == ("pt", 1, DAYS[25])
    assert row.fwd_ret == pytest.approx(close[25] / close[20] - 1)


def test_label_t1_and_return_agree_everywhere(spark):
    close = wobble(40)
    got = pdf(labels.triple_barrier(bars(spark, close, high={12: 150.0}, low={20: 50.0})), "date")
    at = {d: c for d, c in zip(got.date, got.close)}
    known = got[got.t1.notna()]
    assert np.allclose(known.fwd_ret, [at[t] / c - 1 for t, c in zip(known.t1, known.close)])
    assert got.iloc[-1].t1 is None or pd.isna(got.iloc[-1].t1)


def test_tie_in_one_bar_is_a_stop(spark):
    close = wobble(40)
    row = pdf(labels.triple_barrier(bars(spark, close, high={25: 150.0}, low={25: 50.0})), "date").iloc[20]
    assert (row.barrier, row.label) == ("both->sl", 0)


def test_no_label_while_deviation_is_unknown(spark):
    got = pdf(labels.triple_barrier(bars(spark, wobble(15))), "date")
    assert got.sigma.iloc[:2].isna().all() and got.label.iloc[:2].isna().all() and got.label.iloc[2:14].notna().all()


def test_daily_vol_matches_a_library_ewm(spark):
    rng = np.random.default_rng(1)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 300)))
    got = pdf(fx.daily_vol(bars(spark, close)), "date").sigma
    want = np.log(pd.Series(close)).diff().ewm(span=20).std()
    assert np.allclose(got, want, equal_nan=True, rtol=1e-9)


# ---- features --------------------------------------------------------------------------------------------------------


def test_future_shock_never_changes_the_past(spark):
    rng = np.random.default_rng(3)
    close = 100 + np.cumsum(rng.normal(0, 0.5, 260))
    shocked = close.copy()
    shocked[240:] *= 1.2
    build = lambda c: pdf(fx.regime_features(fx.micro_features(fx.price_features(bars(spark, c)))), "date")
    a, b = build(close), build(shocked)
    for x in fx.PRICE + fx.MICRO + fx.REGIME:
        assert np.allclose(a[x].astype(float)[:240], b[x].astype(float)[:240], equal_nan=True), x
        assert a[x].notna().any(), x


def test_fractional_difference_starts_where_its_window_is_full(spark):
    width = len(fx.ffd_weights())
    got = pdf(fx.price_features(bars(spark, np.linspace(100, 200, width + 80))), "date")
    assert width == 55
    assert got.fd_close.first_valid_index() == width - 1
    assert got.fd_vol21.first_valid_index() == 21 + width - 1


def test_rsi_matches_a_library_ewm(spark):
    rng = np.random.default_rng(4)
    close = pd.Series(100 + np.cumsum(rng.normal(0, 1, 120)))
    step = close.diff()
    gain, loss = step.clip(lower=0).ewm(alpha=1 / 14).mean(), (-step.clip(upper=0)).ewm(alpha=1 / 14).mean()
    want = 100 - 100 / (1 + gain / loss.replace(0, np.nan))
    assert np.allclose(pdf(fx.price_features(bars(spark, close), ("rsi_14",)), "date").rsi_14, want, equal_nan=True)


def test_explosivity_matches_least_squares(spark):
    rng = np.random.default_rng(5)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 110)))
    got = pdf(fx.explosivity(bars(spark, close)), "date").explosivity
    y = np.log(close)
    best = -math.inf
    for w in range(20, 81):
        d, x = np.diff(y)[-w:], y[:-1][-w:]
        design = np.column_stack((np.ones(w), x))
        beta = np.linalg.lstsq(design, d, rcond=None)[0]
        rest = d - design @ beta
        best = max(best, beta[1] / math.sqrt(rest @ rest / (w - 2) * np.linalg.inv(design.T @ design)[1, 1]))
    assert got.iloc[-1] == pytest.approx(best, rel=1e-8)
    assert got.first_valid_index() == 20


def test_percentile_rank_averages_ties_and_skips_null(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 2.0), (1, None), (1, 3.0)], "date int, x double")
    got = [r.r for r in df.withColumn("r", C.pct_rank("x")).orderBy("x").collect()]
    assert got == [None, 0.375, 0.375, 0.75, 1.0]


def test_as_of_takes_whole_rows_and_never_looks_ahead(spark):
    left = spark.createDataFrame([("A", d) for d in (1, 5, 9)] + [("B", 5)], "ticker string, t int")
    right = spark.createDataFrame([("A", 5, 1, 10.0), ("A", 8, 2, None), ("A", 8, 3, None)], "ticker string, t int, o int, v double")
    got = fx.as_of(left, right, "ticker", "t", "t", ["o"], ["o", "v"]).orderBy("ticker", "t").collect()
    assert [(r.o, r.v) for r in got] == [(None, None), (1, 10.0), (3, None), (None, None)]


# ---- weights ---------------------------------------------------------------------------------------------------------


def intervals(spark, pairs, n=10):
    base = bars(spark, [100 + i for i in range(n)]).withColumn("idx", F.dayofyear("date") * 0 + F.row_number().over(C.by_ticker()))
    ends = spark.createDataFrame([(a + 1, b + 1) for a, b in pairs], "idx int, res_idx int")
    return base.join(ends, "idx", "left")


def test_isolated_label_has_uniqueness_one(spark):
    got = labels.average_uniqueness(intervals(spark, [(0, 2), (4, 6)])).where("uniq is not null").collect()
    assert [r.uniq for r in got] == [1.0, 1.0]


def test_overlap_shares_uniqueness(spark):
    got = labels.average_uniqueness(intervals(spark, [(0, 3), (1, 3)])).where("uniq is not null").orderBy("idx").collect()
    assert [r.uniq for r in got] == pytest.approx([0.625, 0.5])


def test_weights_have_mean_one_and_zero_without_label(spark):
    got = labels.sample_weights(intervals(spark, [(0, 3), (1, 4), (2, 5)]), "return_attr").toPandas()
    assert got[got.w > 0].w.mean() == pytest.approx(1) and (got[got.res_idx.isna()].w == 0).all()


# ---- validation ------------------------------------------------------------------------------------------------------


def split_members(spark, n, hold, groups, embargo):
    rows = [("A", DAYS[i], DAYS[min(i + hold, n - 1)], i) for i in range(n)]
    df = spark.createDataFrame(rows, "ticker string, date date, t1 date, pos int")
    got = validation.roles(df, groups, 2, embargo).toPandas()
    return {k: (set(g[g.role == "train"].pos), set(g[g.role == "test"].pos)) for k, g in got.groupby("split_id")}


@pytest.mark.parametrize("hold,embargo", [(0, 5), (10, 0), (10, 3)])
def test_splits_match_brute_force(spark, hold, embargo):
    from itertools import combinations

    n, groups = 60, 6
    got = split_members(spark, n, hold, groups, embargo)
    blocks = np.array_split(np.arange(n), groups)
    for k, pair in enumerate(combinations(range(groups), 2)):
        test = {int(i) for b in pair for i in blocks[b]}
        train = set(range(n)) - test
        for b in pair:
            a, z = blocks[b][0], blocks[b][-1]
            train -= {i for i in train if (min(i + hold, n - 1) >= a and i <= z) or z < i <= min(z + embargo, n - 1)}
        assert got[k] == (train, test)
    assert len(got) == 15 and validation.n_paths() == 5


def test_effective_n(spark):
    df = spark.createDataFrame([(d,) for d in DAYS[:200]] * 2, "date date")
    assert validation.effective_n(df, 10).first().n_eff == 20
    assert validation.effective_n(df.limit(3), 10).first().n_eff == 1


# ---- statistics ------------------------------------------------------------------------------------------------------


def test_normal_distribution_text(spark):
    xs = [-38.0, -8.0, -3.2, -0.7, 0.0, 0.3, 2.5, 9.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r.p for r in df.select(F.expr(cdf("x")).alias("p")).collect()]
    assert got == pytest.approx([NormalDist().cdf(x) for x in xs], abs=1e-14)
    ps = [1e-12, 1e-5, 0.02, 0.3, 0.5, 0.77, 0.99, 1 - 1e-7]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r.x for r in df.select(F.expr(ppf("p")).alias("x")).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-9, abs=1e-12)


def test_moments_match_a_library(spark):
    rng = np.random.default_rng(0)
    x = rng.gamma(2, size=50)
    got = stats.summary(spark.createDataFrame([(float(v),) for v in x], "x double"), "x").first()
    s = pd.Series(x)
    assert (got.skew, got.kurt, got.sharpe) == pytest.approx((s.skew(), s.kurt() + 3, s.mean() / s.std()))


def test_sharpe_of_constant_or_single_value_is_null(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert df.agg(stats.sharpe("x").alias("s")).first().s is None
    assert df.limit(1).agg(stats.sharpe("x").alias("s")).first().s is None


def test_deflated_sharpe_is_below_probabilistic(spark):
    df = spark.createDataFrame([(0.1, 200.0)], "sr double, n double")
    log = spark.createDataFrame(trials.SEEDS + [("L4", 0.03)], trials.SCHEMA)
    got = stats.deflated_sharpe(stats.probabilistic_sharpe(df, "sr", "n"), log, "sr", "n").first()
    assert 0 < got.dsr < got.psr < 1
    assert got.psr == pytest.approx(stats.psr_value(0.1, 0, 200))
    one = spark.createDataFrame([("L0", 0.0)], trials.SCHEMA)
    assert stats.deflated_sharpe(df, one, "sr", "n").first().dsr is None


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(0.1, 0), (0.5, 0), (0.5, 1), (0.9, 1)], "score double, label int")
    assert stats.auc(df).first().auc == pytest.approx(0.875)


def test_relevance_has_the_sizes_of_linear_quantiles(spark):
    df = spark.createDataFrame([("A", DAYS[i], float(i)) for i in range(13)], "ticker string, date date, x double")
    got = stats.relevance(df, "x").groupBy("relevance").count().orderBy("relevance").collect()
    assert [r["count"] for r in got] == [3, 2, 3, 2, 3]


# ---- costs and books -------------------------------------------------------------------------------------------------


def test_impact_is_a_square_root_and_zero_below_zero(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.0,), (-1.0,)], "p double")
    got = [r.c for r in df.select(C.impact_bps(F.col("p"), 0.02).alias("c")).collect()]
    assert got == pytest.approx([20.0, 40.0, 0.0, 0.0])
    one = df.select(C.net_of_costs(F.lit(0.01), F.lit(0.5), F.col("p"), 0.02).alias("a"), C.round_trip_bps(F.col("p"), 0.02).alias("b")).first()
    assert (one.a, one.b) == pytest.approx((0.01 - 0.5 * 30 / 1e4, 60.0))


def test_turnover_counts_entries_exits_and_no_final_sale(spark):
    held = spark.createDataFrame([(1, "A", 0.5), (1, "B", -0.5), (2, "A", 0.5), (2, "C", -0.5)], "k int, ticker string, w double")
    assert [(r.k, r.turnover) for r in book.turnover(held).orderBy("k").collect()] == [(1, 1.0), (2, 1.0)]


def test_a_name_on_the_median_is_short_and_counts_in_both_legs(spark):
    df = spark.createDataFrame([(DAYS[0], t, s, 0.01) for t, s in zip("ABCDE", (1.0, 2.0, 3.0, 4.0, 5.0))], "date date, ticker string, score double, fwd_ret double")
    got = {r.ticker: r.w for r in book.book(df, 0.5, 0.5, 4).collect()}
    assert got == pytest.approx({"A": -1 / 6, "B": -1 / 6, "C": -1 / 6, "D": 1 / 6, "E": 1 / 6})


# ---- panel and sources -----------------------------------------------------------------------------------------------


def test_adjustment_factor_with_a_zero_step(spark):
    ev = spark.createDataFrame([("AAA0", DAYS[2], 1.0, 10.0), ("AAA0", DAYS[4], 20.0, 10.0)], "ticker string, ex_date date, value double, close_prior double")
    got = pdf(panel.adjustment_factor(bars(spark, [1.0] * 6), ev), "date").factor.tolist()
    assert got == pytest.approx([0.0, 0.0, 0.0, 0.0, 1.0, 1.0])


def test_min_bars_and_universe(spark):
    two = bars(spark, wobble(5)).unionByName(bars(spark, wobble(3), "BBB1"))
    assert {r.ticker for r in panel.with_min_bars(two, 4).select("ticker").distinct().collect()} == {"AAA0"}
    st = spark.createDataFrame([("A", 10.0, 1e6, 5.0), ("BF", 10.0, 1e6, 9.0), ("C", 10.0, 1e6, None), ("D", 0.0, 1e6, 1.0)], "ticker string, close double, volume double, market_cap double")
    assert [r.ticker for r in panel.select_universe(st, 5).collect()] == ["A", "C"]


def test_trials_log(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    log = trials.load(spark, path)
    assert log.count() == 0
    seeds = spark.createDataFrame(trials.SEEDS, trials.SCHEMA)
    trials.save(trials.seed(log, seeds), path)
    trials.save(trials.append(trials.load(spark, path), spark.createDataFrame([("L1", 0.5)], trials.SCHEMA)), path)
    got = {r.name: r.sharpe for r in trials.seed(trials.load(spark, path), seeds).collect()}
    assert got["L1"] == 0.5 and len(got) == 4


def test_fixed_width_round_trip_and_filters(spark):
    b = bars(spark, [10.25, 11.5]).withColumn("open", F.col("close"))
    lines = readers.render_fixed_width(b).unionByName(spark.createDataFrame([("00HEADER",), ("0120200101XX",), ("",)], "value string"))
    got = readers.fixed_width(lines, ["AAA0"]).orderBy("date").collect()
    assert [(r.date, r.close, r.volume) for r in got] == [(DAYS[0], 10.25, 1000000), (DAYS[1], 11.5, 1000000)]


def test_price_json_takes_the_last_object_text(spark):
    body = '{"results":[{"symbol":"X","historicalDataPrice":[{"date":86400,"open":1,"high":2,"low":1,"close":1.5,"adjustedClose":1.4,"volume":9}]}]}'
    text = f'[{{"type":"text","text":"{{}}"}},{{"type":"text","text":{__import__("json").dumps(body)}}},{{"type":"text","text":"note"}}]'
    got = readers.price_envelope(spark.createDataFrame([(text,)], "value string")).collect()
    assert [(r.date, r.ticker, r.adjustedClose) for r in got] == [(dt.date(1970, 1, 2), "X", 1.4)]
    one = '{"symbol":"X","requestedSymbol":"Y","historicalDataPrice":[{"date":86400,"close":1.5}]}'
    got = readers.price_rest(spark.createDataFrame([(one,)], "value string")).collect()
    assert [(r.ticker, r.close, r.adjustedClose) for r in got] == [("Y", 1.5, None)]


def test_fundamentals_json_falls_back_on_zero(spark):
    text = '{"symbol":"X","data":[{"endDate":"2020-03-31T00:00","trailingEps":0,"earningsPerShare":2.5,"yield":0.1},{"bookValue":1}]}'
    got = readers.fundamentals_json(spark.createDataFrame([(text,)], "value string")).collect()
    assert [(r.end_date, r.trailing_eps, r.div_yield_raw, r.available) for r in got] == [(dt.date(2020, 3, 31), 2.5, 0.1, dt.date(2020, 6, 29))]


def test_dividends(spark):
    rows = [("31/12/2019", "1.234,50", "10,00", "ON", "CASH"), ("31/12/2019", "1.234,50", "10,00", "ON", "CASH"), ("bad", "1", "1", "ON", "x"), ("01/01/2020", "0", "1", "ON", "x"), ("01/02/2020", "2", "1", "PN", "x")]
    feed = spark.createDataFrame(rows, "lastDatePriorEx string, valueCash string, closingPricePriorExDate string, typeStock string, corporateAction string")
    got = readers.dividends_of_eras([readers.dividends(feed), readers.dividends(feed)]).collect()
    assert [(r.ex_date, r.value, r.close_prior) for r in got] == [(dt.date(2020, 1, 1), 1234.5, 10.0)]


def test_feature_sets():
    assert fx.feature_set("amihud_only") == ("amihud", "amihud_rank") and len(fx.feature_set("all")) == 40 and len(fx.FEATURE_SETS) == 10


# ---- loops within a ticker -------------------------------------------------------------------------------------------


def test_sequential_bootstrap_prefers_isolated_labels(spark):
    lab = intervals(spark, [(0, 5), (0, 5), (0, 5), (7, 9)])
    lab = lab.where("res_idx is not null").dropDuplicates(["idx", "res_idx"])
    got = models.sequential_bootstrap(lab.withColumn("ticker", F.lit("A")), size=40).toPandas()
    assert len(got) == 40 and set(got.label_idx) <= {1, 8}
    again = models.sequential_bootstrap(lab.withColumn("ticker", F.lit("A")), size=40).toPandas()
    assert got.equals(again)


def test_min_ffd_d_of_noise_is_zero(spark):
    rng = np.random.default_rng(2)
    close = 100 * np.exp(rng.normal(0, 0.01, 300))
    assert models.min_ffd_d(bars(spark, close)).first().d == 0.0
