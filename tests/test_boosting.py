"""The booster: Spark's random numbers, the trees of GBTClassifier, and the same trees in one task, in many, and after data is lost."""

import dataclasses

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from barloom.operators import boosting

SETTINGS = {"maxIter": 6, "maxDepth": 4, "stepSize": 0.3, "subsamplingRate": 0.75, "featureSubsetStrategy": "0.75", "minInstancesPerNode": 15, "seed": 42}
NAMES = [f"x{k}" for k in range(6)]


@pytest.fixture(scope="module")
def rows(spark):
    """A feature without splits, one of few values, and labels that two features explain."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, len(NAMES)))
    x[:, 1], x[:, 2] = 0.0, rng.integers(0, 3, size=len(x))
    table = pd.DataFrame(x, columns=NAMES).assign(label=(x[:, 0] + x[:, 2] + rng.normal(size=len(x)) > 1).astype(int))
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(spark.createDataFrame(table).coalesce(1)).select("features", "label").localCheckpoint()


def described(model):
    """Splits and leaf values by line, values to 12 digits: the last ones depend on the library's exponential."""
    lines = model.toDebugString.splitlines()[1:]
    return [f"Predict: {float(line.split()[-1]):.12g}" if "Predict" in line else line for line in lines]


def plan(**other):
    return boosting.Plan(**({"rounds": 3, "depth": 4, "step": 0.3, "row_share": 0.75, "per_node": 5, "min_leaf": 15, "min_gain": 0.0, "seed": 42, "splits": (31,) * 6, "joint": 2} | other))


def blocks(settings, sizes=(900, 0, 700)):
    rng = np.random.default_rng(5)
    bins = [rng.integers(0, 32, size=(6, n)) for n in sizes]
    return [boosting.Block(k, boosting.packed(b, settings), np.where(b[0] + rng.integers(0, 20, size=b.shape[1]) > 25, 1, -1).astype(np.int8)) for k, b in enumerate(bins)]


def plain(trees):
    return [{at: (n.split, round(n.value, 12), n.stats[0]) for at, n in nodes.items()} for nodes in trees]


@pytest.mark.parametrize("n", [1, 2, 63, 1000, 5001])
def test_rows_are_drawn_as_spark_draws_them(spark, n):
    for seed in (42, 0, -9, 1 << 40):
        rng = spark.sparkContext._jvm.org.apache.spark.util.random.XORShiftRandom(seed)
        some = min(n, 300)
        drawn = boosting.drawn(seed, n, 0.75)
        assert [i for i in range(some) if rng.nextDouble() < 0.75] == [i for i in drawn.tolist() if i < some]
        assert len(set(drawn.tolist())) == len(drawn) and (n == 0 or drawn.max(initial=0) < n)
    assert boosting.drawn(1, n, 1.0).tolist() == list(range(n))


def test_java_random_and_reservoir(spark):
    jvm = spark.sparkContext._jvm
    rng, ours = jvm.java.util.Random(7), boosting.JavaRandom(7)
    longs = [rng.nextLong() for _ in range(5)]
    assert [ours.next_long() for _ in range(5)] == longs
    for seed in longs:
        kept, rng = list(range(15)), jvm.org.apache.spark.util.random.XORShiftRandom(seed)
        for item in range(15, 20):
            at = int(rng.nextDouble() * (item + 1))
            if at < 15:
                kept[at] = item
        assert boosting.reservoir(20, 15, seed) == kept


@pytest.mark.parametrize("parts", [1, 3])
def test_trees_are_those_of_the_classifier(rows, parts, monkeypatch):
    some = rows if parts == 1 else rows.repartition(parts).localCheckpoint()
    want, got = GBTClassifier(**SETTINGS).fit(some), boosting.Booster(**SETTINGS).fit(some)
    assert described(got) == described(want) and got.getNumTrees == 6 and got.treeWeights == want.treeWeights
    assert np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray(), rtol=1e-9)
    prob = [np.array([r[0][1] for r in m.transform(rows).select("probability").collect()]) for m in (got, want)]
    assert np.allclose(*prob, rtol=1e-9) and prob[0].std() > 0.1
    before = rows.sparkSession.sparkContext._jsc.getPersistentRDDs().size()
    monkeypatch.setattr(boosting, "LOCAL_ROWS", 0)
    assert described(boosting.Booster(**SETTINGS).fit(some)) == described(want)
    assert rows.sparkSession.sparkContext._jsc.getPersistentRDDs().size() <= before


@pytest.mark.parametrize("label", [None, 2])
def test_labels_are_checked_as_by_the_classifier(rows, label):
    odd = rows.withColumn("label", F.when(F.rand(1) > 0.01, F.col("label")).otherwise(F.lit(label).cast("int")))
    with pytest.raises(Exception, match="[Ll]abels MUST"):
        boosting.Booster(**SETTINGS).fit(odd)


def test_pure_rows_make_one_leaf(rows):
    model = boosting.Booster(**(SETTINGS | {"maxIter": 2})).fit(rows.withColumn("label", F.lit(1)))
    want = GBTClassifier(**(SETTINGS | {"maxIter": 2})).fit(rows.withColumn("label", F.lit(1)))
    assert described(model) == described(want) and model.trees[0].depth == 0


def test_sums_of_two_features_and_of_siblings_are_those_of_each(spark):
    one, two = plan(joint=1), plan()
    assert plain(boosting.boosted(boosting.Local(blocks(one), one), one)) == plain(boosting.boosted(boosting.Local(blocks(two), two), two))


def test_many_tasks_make_the_trees_of_one_also_when_their_arrays_are_lost(spark, monkeypatch):
    settings = plan()
    want = plain(boosting.boosted(boosting.Local(blocks(settings), settings), settings))
    sc = spark.sparkContext

    def spread():
        return boosting.Spread(sc.parallelize(blocks(settings), 3), settings)

    source = spread()
    assert plain(boosting.boosted(source, settings)) == want
    source.close()

    class Losing(boosting.Spread):
        lost = 0

        def _summed(self, run, anew):
            self.lost += 1
            if self.lost in (2, 6, 7):
                shelf = self.shelf
                self.homes.foreach(lambda _: shelf.clear())
            return super()._summed(run, anew)

    losing = Losing(sc.parallelize(blocks(settings), 3), settings)
    assert plain(boosting.boosted(losing, settings)) == want and losing.lost > 7
    assert sum(losing.homes.map(lambda i, shelf=losing.shelf: shelf.block(i) is not None).collect()) == 3
    losing.close()
    assert not any(sc.parallelize([0], 1).map(lambda i, shelf=losing.shelf: __import__("os").path.exists(shelf.folder())).collect())


def test_without_candidate_splits_the_root_is_a_leaf():
    settings = dataclasses.replace(plan(), splits=(0,) * 6, per_node=6)
    block = boosting.Block(0, boosting.packed(np.zeros((6, 40), int), settings), np.ones(40, np.int8))
    assert all(set(nodes) == {1} and nodes[1].split is None for nodes in boosting.boosted(boosting.Local([block], settings), settings))
