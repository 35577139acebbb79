"""Boosted models of all splits at once, their evaluation, and what the registered model queries ask for."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.operators import boosting, models, trials
from marlstone.operators import features as fx
from marlstone.operators.boosting import Boosted
from marlstone.plans import catalog


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1200, 3))
    label = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(1200) < 0.1)).astype(int)
    days = pd.Series(np.datetime64("2020-01-01") + np.arange(1200) // 8).dt.date
    frame = pd.DataFrame({"ticker": [f"T{i % 8}" for i in range(1200)], "date": days, "t1": days, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "label": label, "fwd_ret": 0.01 * label + rng.normal(size=1200) * 0.01, "w": 1.0})
    return spark.createDataFrame(frame, "ticker string, date date, t1 date, a double, b double, c double, label int, fwd_ret double, w double")


def test_every_split_is_scored(panel):
    got = models.split_scores(panel, lambda train, test: test.withColumn("score", F.lit(0.5)), embargo=1)
    assert {r[0] for r in got.select("split_id").distinct().collect()} == set(range(15))


def test_boosting_learns_an_interaction_and_keeps_to_its_features(panel):
    rows = panel.withColumn("member", F.when(F.col("date") < "2020-04-30", F.array(F.lit(3), F.lit(5))).otherwise(F.array(F.lit(9))))
    spec = Boosted(("a", "b", "c"), trees=8, least=5, weight="w")
    forest = boosting.fit(rows.where("array_contains(member, 3)"), spec, [3, 5, 9], {5: (2,)})
    assert forest.models == [3, 5]  # nothing teaches model 9
    test = rows.where("array_contains(member, 9)").withColumn("split_id", F.explode(F.array(F.lit(3), F.lit(5), F.lit(9))))
    got = boosting.scored(forest, test).toPandas()
    right = lambda k: ((got[got.split_id == k].score > 0.5) == got[got.split_id == k].label).mean()
    assert right(3) > 0.75 and abs(right(5) - 0.5) < 0.15 and set(got.split_id) == {3, 5}
    assert forest.gain[1, :2].sum() == 0 and forest.gain[0, :2].sum() > 0
    again = boosting.fit(rows.where("array_contains(member, 3)").repartition(7), spec, [3, 5, 9], {5: (2,)})
    assert (again.feature == forest.feature).all() and np.allclose(again.value, forest.value)


def test_ranking_gradients_are_derivatives_of_the_pairwise_loss():
    rng = np.random.default_rng(1)
    margin, y = rng.normal(size=6), np.array([0.0, 2, 1, 0, 4, 2])
    place = np.argsort(np.argsort(-margin))
    worth, discount = 2.0**y - 1, 1 / np.log2(place + 2.0)
    best = sum(w / np.log2(i + 2) for i, w in enumerate(sorted(worth, reverse=True)))
    swap = lambda i, j: abs((worth[i] - worth[j]) * (discount[i] - discount[j])) / best
    loss = lambda m: sum(swap(i, j) * np.log1p(np.exp(m[j] - m[i])) for i in range(6) for j in range(6) if y[i] > y[j])
    g, h = boosting._pairwise(margin, y)
    for i in range(6):
        step = np.zeros(6)
        step[i] = 1e-4
        assert abs((loss(margin + step) - loss(margin - step)) / 2e-4 - g[i]) < 1e-6
        assert abs((loss(margin + step) - 2 * loss(margin) + loss(margin - step)) / 1e-8 - h[i]) < 1e-4


def test_results_of_empty_tables(spark, panel):
    none, adv = panel.where("false"), spark.createDataFrame([], "ticker string, adv double")
    spec = Boosted(("a", "b"), trees=1, depth=1)
    assert models.evaluate(none, spec, adv).count() == 0
    assert models.meta_labelled(none, spec).count() == 0
    assert models.single_split(none, spec)[0].first()["n"] == 0
    assert models.ranked(none.select("ticker", "date", "t1", "fwd_ret", "a"), ("a",), adv, trees=1, depth=1).count() == 0


def test_ablation_logs_each_set(spark, panel):
    adv = spark.createDataFrame([(f"T{i}", 1e6) for i in range(8)], "ticker string, adv double")
    sets = {"both": ("a", "b"), "noise": ("c",)}
    out, log = models.ablation(panel, sets, adv, spark.createDataFrame([], trials.SCHEMA), Boosted((), trees=3, depth=3, least=5, weight="w"), embargo=1)
    got = {r["config"]: r for r in out.collect()}
    assert {r[0] for r in log.select("name").collect()} == {"L0", "L1", "L2", "L3", "abl_both", "abl_noise"}
    assert got["both"]["auc"] > 0.7 > got["noise"]["auc"] and got["both"]["splits"] == 15
    assert got["both"]["trials"] == 5 and got["noise"]["trials"] == 6 and 0 <= got["noise"]["dsr"] <= 1


@pytest.mark.parametrize("name", ["gbt_cpcv", "meta_sizing", "ablation", "ranker"])
def test_queries_ask_for_the_whole_job(name, spark, sf, monkeypatch):
    seen = {}
    for kind in ("evaluate", "meta_labelled", "ablation", "ranked"):
        monkeypatch.setattr(models, kind, lambda *args, **how: seen.update(args=args, how=how) or [None])
    monkeypatch.setattr(catalog, "materialise", lambda df, name="table": df)
    monkeypatch.setattr(catalog, "_weighted", lambda spark, sf_dir: catalog.lb.triple_barrier(catalog.d.bars(spark, sf_dir)).withColumn("w", F.lit(1.0)))
    catalog.QUERIES[name](spark, sf)
    assert not seen["how"]  # every split, default trees
    spec = next((x for x in seen["args"] if isinstance(x, Boosted)), None)
    if name == "ablation":
        assert seen["args"][1] == {n: fx.feature_set(n) for n in fx.FEATURE_SETS} and spec.weight == "w"
    if name == "gbt_cpcv":
        assert spec == Boosted(fx.feature_set("price"), weight="w") and "w" in seen["args"][0].columns
