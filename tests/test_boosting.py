"""The boosting learner: Spark ML's trees, few jobs, no round grown twice."""

import uuid

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from jetloom.operators import boosting as BO
from jetloom.operators import models as ML
from jetloom.operators.splits import add_split
from jetloom.plans import flows

FEATURES = ["a", "b", "c", "flat", "few"]
N = 3000


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(N, 3))
    x[:, 2] = np.round(x[:, 2], 1)
    few = rng.integers(0, 3, N)
    y = np.sin(2 * x[:, 0]) + x[:, 1] * x[:, 2] + 0.3 * few + rng.normal(scale=0.3, size=N)
    data = [(i, *map(float, r), 5.0, int(k), float(t)) for i, (r, k, t) in enumerate(zip(x, few, y))]
    table = spark.createDataFrame(data, "event_id bigint, a double, b double, c double, flat double, few int, y double").repartition(3)
    return add_split(table).where("split != 'test'").withColumn("held", F.col("split") == "validation").cache()


def config(**given):
    return ML.BoostedTreesConfig(**{"rounds": 12, "max_depth": 5, "partition_rows": 700} | given)


def jobs_of(spark, name, run):
    name = f"{name}-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = run()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def spark_ml(rows, given):
    """Spark ML's learner on the partitions that train_boosted_trees takes."""
    assembler = ML._assembler(FEATURES)
    sides = [assembler.transform(ML._few_partitions(rows.where(c).select(*FEATURES, "y"), given.partition_rows)) for c in ("not held", "held")]
    assert sides[0].rdd.getNumPartitions() > 1
    model = GBTRegressor(
        labelCol="y", maxDepth=given.max_depth, stepSize=given.learning_rate, maxIter=given.rounds,
        subsamplingRate=given.subsample, featureSubsetStrategy=str(given.feature_share), seed=given.seed,
    ).fit(sides[0])
    return model, model.evaluateEachIteration(sides[1], "squared")


@pytest.mark.parametrize("share", [0.8, 0.4, 1.0])
@pytest.mark.parametrize("cells", [BO.ONE_TASK_CELLS, 0])
def test_trees_are_those_of_spark_ml(spark, rows, monkeypatch, share, cells):
    monkeypatch.setattr(BO, "ONE_TASK_CELLS", cells)
    seen = []
    cut = ML.patience_cut
    monkeypatch.setattr(ML, "patience_cut", lambda errors, patience: seen.append(list(errors)) or cut(errors, patience))
    given = config(feature_share=share, rounds=12 if cells else 4)
    model = ML.train_boosted_trees(rows, FEATURES, "y", "held", given).stages[-1]
    expected, errors = spark_ml(rows, given)
    assert model.getNumTrees == expected.getNumTrees == len(errors) and model.numFeatures == len(FEATURES)
    assert model.toDebugString.split("\n")[1:] == expected.toDebugString.split("\n")[1:]
    assert list(model.treeWeights) == list(expected.treeWeights)
    assert seen[-1] == pytest.approx(errors, rel=1e-9)


def test_boosting_starts_few_jobs(spark, rows):
    """l1_boosted_trees: six and more jobs a round took most of its time."""
    model, jobs = jobs_of(spark, "few", lambda: ML.train_boosted_trees(rows, FEATURES, "y", "held", config(rounds=30)))
    assert model.stages[-1].getNumTrees == 30 and jobs < 60


def test_larger_tables_take_a_job_a_level(spark, rows, monkeypatch):
    monkeypatch.setattr(BO, "ONE_TASK_CELLS", 0)
    run = lambda n: lambda: ML.train_boosted_trees(rows, FEATURES, "y", "held", config(rounds=n, max_depth=3))
    more, less = jobs_of(spark, "more", run(8))[1], jobs_of(spark, "less", run(2))[1]
    assert more - less <= 6 * (3 + 1) + 2  # a level each, then the errors; a checkpoint


def test_no_round_is_grown_twice(spark, rows, monkeypatch):
    """l2_validation_metrics: runs of 10, 60 and 1,000 rounds took 1,070, and a whole run when the patience passed early."""
    monkeypatch.setattr(BO, "ONE_TASK_CELLS", 0)
    monkeypatch.setattr(ML, "FIRST_ROUNDS", 2)
    numbers = []
    grow = BO.grow
    monkeypatch.setattr(BO, "grow", lambda plan, number, sums: numbers.append(number) or grow(plan, number, sums))
    given = config(rounds=40, max_depth=4, patience=3, learning_rate=0.9)
    model = ML.train_boosted_trees(rows, FEATURES, "y", "held", given)
    assert numbers == list(range(len(numbers))) and len(numbers) < given.rounds
    assert model.stages[-1].getNumTrees == len(numbers) - given.patience  # ended in the round in which the patience passed
    held = ML.regression_metrics(ML.score(model, rows.where("held"), "p"), "y", "p").first()
    expected, errors = spark_ml(rows, given)
    assert held["val_mse"] == pytest.approx(errors[model.stages[-1].getNumTrees - 1], rel=1e-9)
    assert ML.patience_cut(errors, given.patience)[0] == model.stages[-1].getNumTrees


def test_split_counts_are_those_of_spark_ml(spark, rows):
    """l4_split_importance, with a job count that does not follow the rounds."""
    given = config(rounds=20)
    counts, jobs = jobs_of(
        spark, "counts", lambda: ML.split_counts(ML.train_boosted_trees(rows, FEATURES, "y", "held", given), FEATURES).collect()
    )
    debug = spark_ml(rows, given)[0].toDebugString
    assert {r["feature"]: r["importance"] for r in counts} == {f: debug.count(f"If (feature {i} ") for i, f in enumerate(FEATURES)}
    assert jobs < 60


def test_training_flow_starts_no_jobs_per_round(spark, rows, monkeypatch):
    """l6_training_flow; the tables it returns are not looked at here."""
    monkeypatch.setattr(flows.M, "evaluate_predictions", lambda test: test)
    table = rows.select("event_id", F.col("y").alias(flows.TARGET), "a", "b", "c")
    train = lambda n: lambda: flows.train(table, (), config(rounds=n))
    (longer, more), (shorter, less) = jobs_of(spark, "more", train(40)), jobs_of(spark, "less", train(10))
    assert longer.model.stages[-1].getNumTrees > 10 and more - less < 20
    assert longer.validation_metrics.first()["val_mse"] < shorter.validation_metrics.first()["val_mse"]
