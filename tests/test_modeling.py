"""The fits: a signal that is there is found, the gate decides on the final fit, splits keep their sizes."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import evaluation as ev
from barloom.operators import modeling
from barloom.operators.technical import FEATURES

CFG = modeling.Boosting(rounds=12, step=0.2, min_leaf=5)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(1)
    days = pd.bdate_range("2015-01-01", "2019-06-30")[::3]
    rows = []
    for s in range(8):
        x = rng.normal(size=(len(days), len(FEATURES)))
        ret = 0.02 * x[:, 0] + 0.01 * rng.normal(size=len(days))
        part = pd.DataFrame(x, columns=FEATURES).assign(symbol=f"S{s}", date=days.date, fwd_ret=ret, rel_fwd_ret=ret, label=(ret > 0).astype(int))
        rows.append(part)
    return spark.createDataFrame(pd.concat(rows)).withColumn("label", F.col("label").cast("int"))


def test_train_eval_finds_the_signal(spark, panel):
    model, scored, quality = modeling.train_eval(panel, CFG)
    q = quality.first()
    assert q["usable"] and q["auc"] > 0.85 and q["ic"] > 0.6 and q["acc"] > 0.75
    n = panel.count()
    assert scored.count() == n - int(np.floor(n * 0.8))
    top = modeling.importances(model).first()
    assert top["feature"] == FEATURES[0] and top["importance"] > 0.5


def test_walk_forward_scores_every_test_year_out_of_sample(spark, panel):
    metrics, summary = modeling.walk_forward(panel, CFG)
    rows = {r["split"]: r for r in metrics.collect()}
    want = {r["split"]: r for r in ev.walk_forward_splits(panel).collect()}
    assert rows.keys() == want.keys() and len(rows) == 2
    for k, r in rows.items():
        assert (r["n_train"], r["n_test"]) == (want[k]["n_train"], want[k]["n_test"]) and r["auc"] > 0.8
    assert summary.first()["verdict"] == "PASS"


def test_final_fit_is_gated_on_the_rank_correlation(spark, panel):
    metric = lambda ic: spark.createDataFrame([("a", 0.6, ic)], "split string, auc double, ic double")
    assert modeling.train_final(panel, metric(-0.01), CFG) is None
    assert modeling.train_final(panel, metric(0.0), CFG) is None
    model = modeling.train_final(panel, metric(0.02), CFG)
    assert model.stages[-1].getNumTrees == CFG.rounds
    live = panel.where(F.col("date") == F.lit(datetime.date(2019, 6, 28))).drop("label", "fwd_ret", "rel_fwd_ret")
    assert {r["direction"] for r in modeling.predict(model, live, True).collect()} <= {"bullish", "bearish", "sideways"}


def test_one_class_is_not_fitted(spark, panel):
    metrics, summary = modeling.walk_forward(panel.withColumn("label", F.lit(1)), CFG)
    assert {(r["auc"], r["ic"]) for r in metrics.collect()} == {(0.5, 0.0)} and summary.first()["verdict"] == "FAIL"


def test_fit_releases_its_rows_and_keeps_large_panels_spread(spark, panel, monkeypatch):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    monkeypatch.setattr(modeling, "ROWS_PER_TASK", 500)
    modeling.fit(modeling.Boosting(rounds=1), panel.repartition(12))
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before


def test_concurrent_fits_equal_the_serial_ones(spark):
    import time

    from barloom.operators import modeling
    from barloom.plans.signals import full_panel
    from barloom.session import cut_lineage
    from barloom.sources.tables import Tables

    panel = cut_lineage(full_panel(Tables(spark, "/root/testdata/sf0.01")))
    few = modeling.Boosting(rounds=3, depth=2, step=0.05)
    modeling.walk_forward(panel, few, at_once=2)
    took, found = {}, {}
    for at_once in (1, 4):
        start = time.perf_counter()
        metrics, summary, model = modeling.walk_forward_run(panel, few, few, at_once)
        took[at_once] = time.perf_counter() - start
        found[at_once] = (sorted(map(tuple, metrics.collect())), modeling.run_record(panel, summary, model).first())
    assert found[1] == found[4] and len(found[1][0]) > 1
    mean_ic, fitted, n_rows, n_trees = (found[4][1][c] for c in ("mean_ic", "fitted", "n_rows", "n_trees"))
    assert fitted == (mean_ic > 0) and (n_rows, n_trees) == ((panel.count(), 3) if fitted else (0, 0))
    assert took[4] < took[1]


def test_a_failing_fit_is_raised(spark):
    from barloom.operators import modeling

    def bad():
        raise KeyError("no")

    with pytest.raises(KeyError):
        modeling.in_parallel([lambda: 1, bad, lambda: 2], 2)
    assert modeling.in_parallel([lambda k=k: spark.range(k).count() for k in range(5)], 3) == [0, 1, 2, 3, 4]


def test_the_final_fit_runs_beside_the_walk_forward(spark, panel, monkeypatch):
    import threading

    walk, final = modeling.Boosting(rounds=1), modeling.Boosting(rounds=2)
    plain, started = modeling.fit, threading.Event()

    def watched(cfg, rows):
        if cfg is final:
            started.set()
        else:
            assert started.wait(30)
        return plain(cfg, rows)

    monkeypatch.setattr(modeling, "fit", watched)
    assert modeling.walk_forward_run(panel, walk, final)[2].stages[-1].getNumTrees == 2


def test_a_final_fit_that_fails_behind_a_shut_gate_is_not_raised(spark, panel, monkeypatch):
    def bad(cfg, rows):
        raise ValueError("one class")

    monkeypatch.setattr(modeling, "fit", bad)
    assert modeling.walk_forward_run(panel.withColumn("label", F.lit(1)), CFG, CFG)[2] is None


def test_a_fit_takes_a_task_per_core_unless_tasks_get_too_large(spark, panel, monkeypatch):
    class Spread:
        def fit(self, rows):
            return rows.rdd.getNumPartitions()

    cores, n = spark.sparkContext.defaultParallelism, panel.count()
    monkeypatch.setattr(modeling, "estimator", lambda cfg: Spread())
    monkeypatch.setattr(modeling, "ROWS_PER_TASK", 2)
    assert modeling.fit(CFG, panel.repartition(3 * cores)) == cores
    monkeypatch.setattr(modeling, "MOST_ROWS", -(-n // (2 * cores)))
    assert cores < modeling.fit(CFG, panel.repartition(3 * cores)) <= 2 * cores
