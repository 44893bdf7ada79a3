"""Direction model on ``pyspark.ml``: train and evaluate, walk-forward, final fit, inference."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import TypeVar

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from barloom.functions.ranking import positional_split
from barloom.operators import evaluation as ev
from barloom.operators.boosting import Booster
from barloom.operators.technical import FEATURES, direction_from_prob
from barloom.session import cut_lineage

ROWS_PER_TASK, MOST_ROWS = 50_000, 500_000
AT_ONCE, POOL = 4, "fits"
T = TypeVar("T")


@dataclass(frozen=True)
class Boosting:
    """Boosted-tree settings (fixed values of the research process; rounds are a budget)."""

    rounds: int = 400
    depth: int = 4
    step: float = 0.04
    row_share: float = 0.75
    column_share: str = "0.75"
    min_leaf: int = 15
    seed: int = 42


def estimator(cfg: Boosting) -> Pipeline:
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=FEATURES, outputCol="raw"),
            StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
            Booster(
                featuresCol="features",
                labelCol="label",
                maxIter=cfg.rounds,
                maxDepth=cfg.depth,
                stepSize=cfg.step,
                subsamplingRate=cfg.row_share,
                featureSubsetStrategy=cfg.column_share,
                minInstancesPerNode=cfg.min_leaf,
                seed=cfg.seed,
            ),
        ]
    )


def fit(cfg: Boosting, rows: DataFrame) -> PipelineModel:
    """All rounds over ``rows``; missing inputs count as 0.

    Boosting makes several small jobs a round, so the rows are put into as few
    tasks as ROWS_PER_TASK allows, and into no more than there are cores unless a
    task would get over MOST_ROWS. The kept rows are released afterwards.
    """
    ready = rows.na.fill(0.0, subset=FEATURES).select(*FEATURES, "label").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, cores = ready.count(), ready.sparkSession.sparkContext.defaultParallelism
        tasks = max(1, min(-(-n // ROWS_PER_TASK), cores), -(-n // MOST_ROWS))
        few = ready.coalesce(tasks) if tasks < ready.rdd.getNumPartitions() else ready
        return estimator(cfg).fit(few)
    finally:
        ready.unpersist()


def score(model: PipelineModel, panel: DataFrame) -> DataFrame:
    """(symbol, date, proba, pred, label, fwd_ret); missing inputs count as 0."""
    ready = panel.na.fill(0.0, subset=FEATURES)
    if "label" not in ready.columns:
        ready = ready.withColumns({"label": F.lit(None).cast("int"), "fwd_ret": F.lit(None).cast("double")})
    out = model.transform(ready)
    return out.select(
        "symbol", "date", vector_to_array("probability")[1].alias("proba"), F.col("prediction").cast("int").alias("pred"), "label", "fwd_ret"
    )


def train_eval(panel: DataFrame, cfg: Boosting = Boosting(), train_share: float = 0.8) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Fit on the first 80 % of rows by date; (model, scored test rows, quality row).

    The panel is checkpointed before it is split (the split reads it three times)
    and after, as boosting must not recompute the features when an executor is lost.
    """
    rows = cut_lineage(positional_split(cut_lineage(panel), train_share))
    model = fit(cfg, rows.where("is_train"))
    scored = cut_lineage(score(model, rows.where("not is_train")))
    quality = ev.quality_gate(ev.accuracy(scored), ev.roc_auc(scored), ev.rank_ic(scored))
    return model, scored, quality


def in_parallel(tasks: Sequence[Callable[[], T]], at_once: int) -> list[T]:
    """Results of ``tasks``, each a driver-side caller of Spark jobs, run ``at_once`` at a time in scheduler pools of their own.

    A fit is a long row of short jobs that leave most cores idle; several of them
    fill a cluster. The first failure is raised.
    """
    session = SparkSession.active()

    def pooled(k: int) -> Callable[[], T]:
        def run() -> T:
            session.sparkContext.setLocalProperty("spark.scheduler.pool", f"{POOL}-{k % at_once}")
            return tasks[k]()

        return inheritable_thread_target(session)(run)

    if at_once <= 1:
        return [task() for task in tasks]
    with ThreadPoolExecutor(at_once) as pool:
        return [f.result() for f in [pool.submit(pooled(k)) for k in range(len(tasks))]]


def scored_splits(rows: DataFrame, cfg: Boosting, at_once: int = AT_ONCE) -> tuple[DataFrame, DataFrame]:
    """(scored test rows with their split, splits) of checkpointed ``rows``; the fits of all test years are independent and run together."""
    splits = ev.walk_forward_splits(rows)

    def fitted(split: Row) -> Callable[[], DataFrame]:
        def run() -> DataFrame:
            train = rows.where(F.col("date") < F.lit(split["test_start"]))
            test = rows.where((F.col("date") >= F.lit(split["test_start"])) & (F.col("date") < F.lit(split["test_end"])))
            if train.select("label").distinct().count() < 2:
                part = test.select("symbol", "date", F.lit(0.5).alias("proba"), F.lit(0).alias("pred"), "label", "fwd_ret")
            else:
                part = score(fit(cfg, train), test)
            return part.withColumn("split", F.lit(split["split"]))

        return run

    parts = in_parallel([fitted(s) for s in splits.orderBy("test_start").collect()], at_once)  # a split per year
    if not parts:
        parts = [rows.where(F.lit(False)).select("symbol", "date", F.lit(0.5).alias("proba"), F.lit(0).alias("pred"), "label", "fwd_ret", F.lit("").alias("split"))]
    return cut_lineage(reduce(DataFrame.unionByName, parts)), splits


def walk_forward(panel: DataFrame, cfg: Boosting = Boosting(rounds=300, step=0.05), at_once: int = AT_ONCE) -> tuple[DataFrame, DataFrame]:
    """(metrics per split, summary with verdict); one fit per test year, ``at_once`` of them at a time."""
    metrics = cut_lineage(ev.split_metrics(*scored_splits(cut_lineage(panel), cfg, at_once)))
    return metrics, ev.summarise_splits(metrics)


def train_final(panel: DataFrame, metrics: DataFrame, cfg: Boosting = Boosting(), ahead: Future[PipelineModel] | None = None) -> PipelineModel | None:
    """Fit on every row, only when the mean rank correlation over splits is positive; ``ahead`` is that fit, if it has been started before."""
    mean_ic = metrics.agg(F.avg("ic").alias("ic")).first()["ic"]
    if mean_ic is None or mean_ic <= 0:
        return None
    return ahead.result() if ahead else fit(cfg, cut_lineage(panel))


def walk_forward_run(panel: DataFrame, walk: Boosting = Boosting(rounds=300, step=0.05), final: Boosting = Boosting(), at_once: int = AT_ONCE) -> tuple[DataFrame, DataFrame, PipelineModel | None]:
    """(metrics, summary, final model or None): features are stored once, the final fit is gated on the same run's rank correlation.

    The final fit needs nothing of the walk-forward but the gate, so it runs beside it (unless
    ``at_once`` is 1) and its model is dropped where the gate stays shut.
    """
    rows = cut_lineage(panel)
    if at_once <= 1:
        metrics, summary = walk_forward(rows, walk, at_once)
        return metrics, summary, train_final(rows, metrics, final)
    session = SparkSession.active()

    def run() -> PipelineModel:
        session.sparkContext.setLocalProperty("spark.scheduler.pool", f"{POOL}-final")
        return fit(final, rows)

    with ThreadPoolExecutor(1) as pool:
        ahead = pool.submit(inheritable_thread_target(session)(run))
        metrics, summary = walk_forward(rows, walk, at_once)
        return metrics, summary, train_final(rows, metrics, final, ahead)


def run_record(panel: DataFrame, summary: DataFrame, model: PipelineModel | None) -> DataFrame:
    """One row: (mean_ic, verdict, fitted, n_rows, n_trees) of a run and what its final fit saw."""
    trees = model.stages[-1].getNumTrees if model is not None else 0
    size = panel.agg(F.count("*").alias("n")).scalar()
    return summary.select("mean_ic", "verdict", F.lit(model is not None).alias("fitted"), F.when(F.lit(model is not None), size).otherwise(0).cast("long").alias("n_rows"), F.lit(trees).alias("n_trees"))


def importances(model: PipelineModel) -> DataFrame:
    """(feature, importance), largest first."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(FEATURES, values)]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def predict(model: PipelineModel | None, live: DataFrame, usable: bool) -> DataFrame:
    """(symbol, prob_up, direction, confidence); 0.5 and sideways without a usable model."""
    if model is None or not usable:
        proba = live.select("symbol", F.lit(0.5).alias("prob_up"))
        return proba.select("*", F.lit("sideways").alias("direction"), F.lit(0.0).alias("confidence"))
    s = score(model, live)
    direction, confidence = direction_from_prob(F.col("proba"))
    return s.select("symbol", F.col("proba").alias("prob_up"), direction.alias("direction"), confidence.alias("confidence"))
