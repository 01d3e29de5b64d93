"""Boosted trees of one task against Spark ML's own."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from sellerscope.operators import boosting, models
from sellerscope.session import stage

COLUMNS = [f"c{i}" for i in range(7)]


def rows_of(spark, n, partitions, seed):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, 7)) < 0.5, rng.integers(0, 6, (n, 7)), rng.normal(size=(n, 7)).round(2))
    x[:, 6] = 3.0  # without a split
    y = ((x[:, 0] > 2) ^ (x[:, 1] + x[:, 2] > 3) | (rng.random(n) < 0.15)).astype(int)
    frame = pd.DataFrame(x, columns=COLUMNS).assign(is_negative=y, weight=np.where(y == 1, 3.37, 1.0))
    return stage(spark.createDataFrame(frame).repartition(partitions, "c1"), "boosting-rows")


def classifier(trees, depth):
    return GBTClassifier(
        labelCol="is_negative", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.05, subsamplingRate=0.9, featureSubsetStrategy="0.8", seed=42
    )


def splits_of(tree):
    return re.findall(r"feature (\d+) <= ([-\d.E]+)", tree.toDebugString)


# From 12,000 and 40,000 rows split candidates are taken from samples, drawn in two ways.
@pytest.mark.parametrize("n, partitions, trees, depth", [(900, 1, 4, 4), (3000, 3, 2, 6), (12_000, 2, 2, 3), (40_000, 2, 2, 2)])
def test_trees_are_those_of_spark(spark, n, partitions, trees, depth):
    frame = rows_of(spark, n, partitions, seed=n)
    assembled = VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(frame)
    theirs = classifier(trees, depth).fit(assembled)
    ours = boosting.fit_in_one_task(classifier(trees, depth), frame, COLUMNS)
    assert [splits_of(t) for t in ours.trees] == [splits_of(t) for t in theirs.trees]
    assert ours.treeWeights == theirs.treeWeights and ours.numFeatures == theirs.numFeatures
    values = lambda model: [r[0] for r in model.transform(assembled).select("probability").collect()]
    assert np.abs(np.array(values(ours)) - np.array(values(theirs))).max() < 1e-12
    assert ours.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), abs=1e-12)


def test_draws_do_not_depend_on_blocks(monkeypatch):
    whole = boosting.bags([5, 0, 23, 8], range(3), 0.9, 42)
    monkeypatch.setattr(boosting, "DRAWN_AT_ONCE", 4)
    assert (boosting.bags([5, 0, 23, 8], range(3), 0.9, 42) == whole).all()
    assert (boosting.bags([5, 0, 23, 8], range(2, 3), 0.9, 42) == whole[2:]).all()
    assert 0.7 < whole.mean() < 1


def test_jobs_do_not_grow_with_trees(spark):
    frame = rows_of(spark, 400, 2, seed=1)

    def jobs(trees):
        spark.sparkContext.setJobGroup(f"trees-{trees}", "boosting")
        models.fit_boosted(frame, COLUMNS, trees=trees, depth=3)
        spark.sparkContext._jsc.clearJobGroup()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"trees-{trees}"))

    assert jobs(1) == jobs(9)


@pytest.mark.parametrize("weighting", ["positive", "balanced"])
def test_same_model_with_many_rows(spark, monkeypatch, weighting):
    frame = rows_of(spark, 500, 2, seed=5)
    scores = []
    for most in (boosting.ONE_TASK_ROWS, 0):
        monkeypatch.setattr(models, "ONE_TASK_ROWS", most)
        model = models.fit_boosted(frame, COLUMNS, trees=2, depth=2, weighting=weighting)
        scores.append(sorted(r["score"] for r in models.score(model, frame).collect()))
    assert scores[0] == pytest.approx(scores[1], abs=1e-12)


def test_one_class_and_missing_values(spark):
    frame = rows_of(spark, 60, 1, seed=2)
    for label in (0, 1):
        one = frame.filter(F.col("is_negative") == label)
        model = models.fit_boosted(one, COLUMNS, trees=2, depth=2, weighting="balanced")
        assert {r["score"] > 0.5 for r in models.score(model, one).collect()} == {label == 1}
    with pytest.raises(Exception, match="missing"):
        models.fit_boosted(frame.withColumn("c1", F.lit(None).cast("double")), COLUMNS, trees=1)


def test_no_weight_gives_even_odds(spark):
    frame = rows_of(spark, 60, 1, seed=2).withColumn("weight", F.lit(0.0))
    model = Pipeline(stages=[VectorAssembler(inputCols=COLUMNS, outputCol="features")]).fit(frame)
    fitted = boosting.fit_in_one_task(classifier(2, 2), frame, COLUMNS)
    assert {r[0][0] for r in fitted.transform(model.transform(frame)).select("probability").collect()} == {0.5}
