"""Ranks over whole tables without one task that sorts them, adjustment factors and the trials log, on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import panel, stats, trials


def brute_auc(score, label):
    wins = [(a > b) + 0.5 * (a == b) for a, y in zip(score, label) if y == 1 for b, z in zip(score, label) if z == 0]
    return sum(wins) / len(wins)


def test_auc_equals_pairwise_wins(spark):
    rng = np.random.default_rng(0)
    score, label = np.round(rng.random(300), 2), rng.integers(0, 2, 300)
    score[:100] = 0.5  # a third of all rows share one score
    rows = [(float(s), int(y), "ab"[i % 2]) for i, (s, y) in enumerate(zip(score, label))] + [(None, 1, "a"), (0.1, None, "b"), (float("nan"), 1, "a")]
    df = spark.createDataFrame(rows, "score double, label int, k string")
    got = stats.auc(df).first()
    assert abs(got["auc"] - brute_auc(score, label)) < 1e-12 and got["n"] == 300
    by_key = {r["k"]: r["auc"] for r in stats.auc(df, "score", "label", "k").collect()}
    for j, k in enumerate("ab"):
        assert abs(by_key[k] - brute_auc(score[j::2], label[j::2])) < 1e-12


def test_auc_of_one_class_and_of_nothing(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "score double, label int")
    assert tuple(stats.auc(df).first()) == (None, 2)
    assert tuple(stats.auc(df.where("false")).first()) == (None, 0)
    assert stats.auc(df.withColumn("k", F.lit(1)).where("false"), "score", "label", "k").count() == 0


def test_relevance_over_a_table_equals_its_ranks(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=400), 1)
    rows = [(f"t{i % 7}", i, float(v)) for i, v in enumerate(x)] + [("t0", 999, None)]
    df = spark.createDataFrame(rows, "ticker string, date int, fwd double")
    got = {(r["ticker"], r["date"]): r["relevance"] for r in stats.relevance(df, "fwd").collect()}
    order = sorted(rows[:-1], key=lambda r: (r[2], r[0], r[1]))
    edges = 1 + np.arange(1, 5) * 399 / 5
    assert got == {(t, d): int(np.searchsorted(edges, i + 1, "left")) for i, (t, d, _) in enumerate(order)}


def test_factor_multiplies_later_events(spark):
    bars = spark.createDataFrame([("A", d, None if d == 3 else 10.0) for d in range(1, 7)] + [("B", 1, 5.0)], "ticker string, date int, close double")
    events = [("A", 3, 1.0, 10.0), ("A", 3, 2.0, 10.0), ("A", 5, 10.0, 10.0), ("A", 6, 1.0, 4.0), ("A", 4, 1.0, 0.0), ("A", None, 1.0, 2.0), ("C", 2, 1.0, 2.0)]
    ev = spark.createDataFrame(events, "ticker string, ex_date int, value double, close_prior double")
    got = {(r["ticker"], r["date"]): r["factor"] for r in panel.adjustment_factor(bars, ev).collect()}
    assert got == {("A", 1): 0.0, ("A", 2): 0.0, ("A", 3): 0.0, ("A", 4): 0.0, ("A", 5): 0.75, ("A", 6): 1.0, ("B", 1): 1.0}


def test_trials_log_survives_and_complains(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    assert trials.load(spark, path).count() == 0
    trials.save(spark.createDataFrame([("a", 1.0)], trials.SCHEMA), path)
    trials.save(trials.append(trials.load(spark, path), spark.createDataFrame([("b", 2.0)], trials.SCHEMA)), path)
    assert sorted(map(tuple, trials.load(spark, path).collect())) == [("a", 1.0), ("b", 2.0)]
    for f in (tmp_path / "log").glob("*.parquet"):
        f.write_bytes(b"no table")
    with pytest.raises(Exception):
        trials.load(spark, path).collect()
