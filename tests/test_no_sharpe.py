"""Splits without a Sharpe ratio, as where fewer than four names trade: the momentum evaluation counts them as its SQL does."""

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_queries import rows

import __spark_entry__ as spec
from marlstone.operators import models, trials

#: days on which five brands trade instead of three; of the first 21 none has a score, of the last none a label
WIDE = {"three names": (), "one day": (*range(21), 60, 139), "two days": (*range(21), 60, 110, 139)}


@pytest.mark.parametrize("case", WIDE)
def test_splits_without_sharpe_match_sql(case, spark, tmp_path):
    rng, lines = np.random.default_rng(1), []
    for i in range(140):
        for brand in range(5 if i in WIDE[case] else 3):
            for price in 1800.0 + rng.integers(0, 40, 3):
                lines.append((len(lines), brand, brand, 1, 2.0, price, 0.05, 0.02, dt.datetime(2020, 1, 1) + dt.timedelta(days=i)))
    names = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_shipdate".split()
    frame = pd.DataFrame(lines, columns=names)  # noqa: F841
    duckdb.sql(f"copy (select * replace (l_shipdate::timestamp as l_shipdate) from frame) to '{tmp_path}/lineitem.parquet'")
    duckdb.sql(f"copy (select k as p_partkey, 'Brand#' || k as p_brand, 1000.0::double as p_retailprice from range(5) r(k)) to '{tmp_path}/part.parquet'")
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    without = con.execute(spec.oracle_sql()["cpcv_results"]).df()["sharpe"].isna().sum()
    assert without == {"three names": 15, "one day": 15, "two days": 14}[case]
    want = con.execute(spec.oracle_sql()["cpcv_evaluation"])
    names = [c[0] for c in want.description]
    data = want.fetchall()
    got = spec.queries()["cpcv_evaluation"](spark, str(tmp_path))
    assert rows(got.columns, got.collect()) == rows(names, data)


def test_a_model_without_sharpe_is_no_trial(spark):
    day = dt.date(2020, 1, 1)
    scored = spark.createDataFrame([(0, "A", day, 0.5, 0.1)], "split_id int, ticker string, date date, score double, fwd_ret double")
    results = spark.createDataFrame([(0, 0.6, None, None, None)], "split_id int, auc double, sharpe double, sharpe_gross double, sharpe_net double")
    out, log = models.evaluation(scored, results, spark.createDataFrame([], trials.SCHEMA), "model")
    got = out.first()
    assert (got.n_eff, got.trials, got.skew, got.kurt, got.dsr, log.count()) == (0, 4, 0.0, 3.0, None, 4)


def test_a_function_that_learns_nothing_is_called_once(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(60)]
    data = spark.createDataFrame([("A", d, d, 0) for d in days], "ticker string, date date, t1 date, label int")
    calls = []
    got = models.split_scores(data, lambda train, test: calls.append(1) or test.withColumn("score", F.lit(0.5)), learns=False, embargo=1)
    assert (len(calls), got.count(), got.select("split_id").distinct().count()) == (1, 5 * 60, 15)
