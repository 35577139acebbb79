"""Histories beyond the range of plain powers, and the loops written over them, against pandas and numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.operators import features as fx
from marlstone.operators import labels as lb

N = 50_000


@pytest.fixture(scope="module")
def long_panel(spark):
    rng = np.random.default_rng(3)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, N)) * 0.05)
    date = np.datetime64("1800-01-01") + np.arange(N)
    return pd.DataFrame({"ticker": "A", "date": pd.Series(date).dt.date, "open": close, "high": close * 1.00001, "low": close * 0.99999, "close": close, "volume": 1e6})


SCHEMA = "ticker string, date date, open double, high double, low double, close double, volume double"


def test_ewm_deviation_equals_pandas(spark, long_panel):
    got = fx.daily_vol(spark.createDataFrame(long_panel, SCHEMA)).orderBy("date").select("sigma").toPandas()["sigma"].to_numpy(dtype=float)
    want = np.log(long_panel["close"]).diff().ewm(span=20).std().to_numpy()
    assert np.isnan(got[:2]).all() and not np.isnan(got[2:]).any()
    np.testing.assert_allclose(got[2:], want[2:], rtol=1e-7)


def test_rsi_equals_pandas(spark, long_panel):
    got = fx.price_features(spark.createDataFrame(long_panel, SCHEMA), ("rsi_14",)).orderBy("date").toPandas()["rsi_14"].to_numpy(dtype=float)
    d = long_panel["close"].diff()
    up, down = (x.ewm(alpha=1 / 14).mean() for x in (d.clip(lower=0), -d.clip(upper=0)))
    want = (100 - 100 / (1 + up / down.replace(0, np.nan))).to_numpy()
    assert (np.isnan(got) == np.isnan(want)).all()
    np.testing.assert_allclose(got[20:], want[20:], rtol=1e-8)


def test_late_labels_are_not_all_stops(spark, long_panel):
    t = lb.triple_barrier(spark.createDataFrame(long_panel, SCHEMA)).where("idx > 40000")
    kinds = {r[0]: r[1] for r in t.groupBy("barrier").count().collect()}
    assert kinds["vert"] > 100 and kinds["pt"] > 100 and kinds["sl"] > 100


def test_missing_prices_age_the_others(spark, long_panel):
    part = long_panel.head(300).copy()
    part.loc[[50, 51, 120], "close"] = np.nan
    got = fx.daily_vol(spark.createDataFrame(part, SCHEMA)).orderBy("date").toPandas()["sigma"].to_numpy(dtype=float)
    want = np.log(part["close"]).diff().ewm(span=20).std().to_numpy()
    known = ~np.isnan(got)
    assert known[60:].all()
    np.testing.assert_allclose(got[known], want[known], rtol=1e-8)


def test_explosivity_equals_regressions(spark, long_panel):
    part = long_panel.head(130).copy()
    part.loc[20, "close"] = np.nan
    got = fx.explosivity(spark.createDataFrame(part, SCHEMA), 20, 40, at_once=33).orderBy("date").toPandas()["explosivity"].to_numpy(dtype=float)
    y = np.log(part["close"].to_numpy())
    for t in range(len(y)):
        found = []
        for n in range(20, 41):
            if t - n < 0 or np.isnan(y[t - n : t + 1]).any():
                continue
            x, d = y[t - n : t], np.diff(y[t - n : t + 1])
            a = np.column_stack((np.ones(n), x))
            beta, *_ = np.linalg.lstsq(a, d, rcond=None)
            rest = d - a @ beta
            found.append(beta[1] / np.sqrt(rest @ rest / (n - 2) / ((x - x.mean()) ** 2).sum()))
        assert np.isnan(got[t]) if not found else abs(got[t] - max(found)) < 1e-6


def test_callers_underscore_columns_pass_through(spark, long_panel):
    small = spark.createDataFrame(long_panel.head(80), SCHEMA).withColumns({"_lr": F.lit("mine"), "_i": F.lit(7), "_z": F.lit(1.5), "_p": F.lit(2), "_m": F.lit("m")})
    made = lb.average_uniqueness(lb.triple_barrier(fx.cusum_vol(fx.price_features(fx.micro_features(small)), 20)))
    made = lb.sample_weights(fx.explosivity(made), "return_attr")
    assert made.select("_lr", "_i", "_z", "_p", "_m").distinct().collect() == [("mine", 7, 1.5, 2, "m")]


def test_empty_panel(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert lb.sample_weights(lb.triple_barrier(fx.regime_features(fx.micro_features(fx.price_features(none))))).count() == 0
