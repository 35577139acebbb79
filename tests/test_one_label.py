"""Splits whose test or training rows hold one label only, as where every bar of a large table touches both barriers."""

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_queries import rows

import __spark_entry__ as spec
from marlstone.operators import models
from marlstone.operators.boosting import Boosted


@pytest.fixture(scope="module")
def late_labels(tmp_path_factory):
    """Five brands with two lines a day: label 1 occurs on the last days only, so no split has both labels on both sides."""
    rng, lines = np.random.default_rng(0), []
    for i in range(140):
        for brand in range(5):
            wide = i < 132  # unit prices far on both sides of the day's mean, later above it only
            for price, quantity in ((500.0, rng.integers(20, 30)), (2000.0, rng.integers(20, 30))) if wide else ((1100.0 + 100 * (i - 132) + rng.integers(9), 20),):
                lines.append((len(lines), brand, brand, 1, float(quantity), price * quantity, 0.05, 0.02, dt.datetime(2020, 1, 1) + dt.timedelta(days=i)))
    names = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_shipdate".split()
    folder = tmp_path_factory.mktemp("late")
    frame = pd.DataFrame(lines, columns=names)  # noqa: F841
    duckdb.sql(f"copy (select * replace (l_shipdate::timestamp as l_shipdate) from frame) to '{folder}/lineitem.parquet'")
    duckdb.sql(f"copy (select k as p_partkey, 'Brand#' || k as p_brand, 1000.0::double as p_retailprice from range(5) r(k)) to '{folder}/part.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["cpcv_results", "cpcv_evaluation"])
def test_splits_with_one_label_match_sql(name, spark, late_labels):
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"create view {t} as select * from '{late_labels}/{t}.parquet'")
    want = con.execute(spec.oracle_sql()[name])
    names = [c[0] for c in want.description]
    data = want.fetchall()
    if name == "cpcv_results":
        auc = [r[names.index("auc")] for r in data]
        assert len(auc) == 15 and sum(x is None for x in auc) == 10
    got = spec.queries()[name](spark, late_labels)
    assert rows(got.columns, got.collect()) == rows(names, data)


def test_a_model_is_judged_on_both_labels_only(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i // 4) for i in range(240)]
    frame = pd.DataFrame({"ticker": [f"T{i % 4}" for i in range(240)], "date": days, "t1": days, "a": np.arange(240) % 7.0, "label": [int(i >= 200 and i % 2) for i in range(240)], "fwd_ret": 0.01 * (np.arange(240) % 5)})
    data = spark.createDataFrame(frame, "ticker string, date date, t1 date, a double, label int, fwd_ret double")
    adv = spark.createDataFrame([("T0", 1e6)], "ticker string, adv double")
    half = lambda train, test: test.withColumn("score", F.lit(0.5))
    assert models.evaluate(data, half, adv, embargo=1).count() == 0
    assert models.evaluate(data, Boosted(("a",), trees=1, depth=1, least=5), adv, embargo=1).count() == 0
