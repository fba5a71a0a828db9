"""The regressor on the physics loss: gradient, descent, start, degenerate tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from jetloom.operators import models as ML
from jetloom.operators.metrics import physics_loss
from jetloom.operators.physics_fit import PhysicsFitConfig, descend, loss_and_gradient, train_on_physics_loss

FEATURES = ["a", "b", "c"]


def _rows(spark, n=400, spread=1.0):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 3)) * [1.0, 30.0, 0.01] + [0.0, 200.0, 1.0]
    z = spread * (x[:, 0] + (x[:, 1] - 200.0) / 30.0 - 1.0)
    y = np.clip(1.0 / (1.0 + np.exp(-z)) + rng.normal(size=n) * 0.1, 0.0, 1.0)
    return spark.createDataFrame([(*map(float, row), float(t)) for row, t in zip(x, y)], "a double, b double, c double, y double")


def _loss(model, rows, weight):
    scored = ML.score(model, rows, "y_pred").withColumnRenamed("y", "y_true")
    return physics_loss(scored, weight).first().total_loss


@pytest.mark.parametrize("spread", [0.05, 1.0])
@pytest.mark.parametrize("weight", [0.0, 3.0])
def test_gradient_and_loss(spark, spread, weight):
    # A small spread keeps the variance below its least wanted value, so that this penalty is at work.
    table = _rows(spark, 60, spread).select(F.array("a", F.col("b") / 200, "c").alias("x"), "y")
    theta = np.array([-1.2, 0.05 * spread, 0.1, -0.2])
    loss, gradient = loss_and_gradient(table, theta, weight)
    for i in range(len(theta)):
        step = np.zeros(len(theta))
        step[i] = 1e-5
        up, down = (loss_and_gradient(table, theta + s, weight)[0] for s in (step, -step))
        assert gradient[i] == pytest.approx((up - down) / 2e-5, abs=1e-7)
    z = F.lit(theta[0]) + sum(F.get("x", F.lit(i)) * F.lit(theta[i + 1]) for i in range(3))
    pairs = table.select((1 / (1 + F.exp(-z))).alias("y_pred"), F.col("y").alias("y_true"))
    assert loss == pytest.approx(physics_loss(pairs, weight).first().total_loss, abs=1e-12)


@pytest.mark.parametrize("weight", [0.1, 5.0])
def test_no_worse_than_the_likelihood_fit(spark, weight):
    rows = _rows(spark)
    model = train_on_physics_loss(rows, FEATURES, "y", PhysicsFitConfig(physics_weight=weight))
    start, end = _loss(ML.train_bounded(rows, FEATURES, "y"), rows, weight), _loss(model, rows, weight)
    assert end < start
    # No neighbouring parameters do better.
    head = model.stages[-1]
    weights, center = head.coefficients.toArray(), np.array([0.0, 200.0, 1.0])
    base = head.intercept + weights @ center
    table = rows.select(F.array(*[F.col(f) - c for f, c in zip(FEATURES, center)]).alias("x"), "y")
    for i, size in enumerate([1.0, 1.0, 30.0, 0.01]):
        for sign in (-1, 1):
            theta = np.concatenate([[base], weights])
            theta[i] += sign * 1e-2 / size
            assert loss_and_gradient(table, theta, weight)[0] > end


def test_repeats_under_another_partitioning(spark):
    rows = _rows(spark, 200)
    first = train_on_physics_loss(rows.repartition(1), FEATURES, "y").stages[-1]
    second = train_on_physics_loss(rows.repartition(7), FEATURES, "y").stages[-1]
    assert first.coefficients.toArray() == pytest.approx(second.coefficients.toArray(), rel=1e-3, abs=1e-4)


def test_saves_and_loads(spark, tmp_path):
    rows = _rows(spark, 100)
    model = train_on_physics_loss(rows, FEATURES, "y")
    ML.save_model(model, str(tmp_path / "m"), {})
    loaded, _ = ML.load_model(str(tmp_path / "m"))
    assert sorted(ML.score(loaded, rows, "p").collect()) == sorted(ML.score(model, rows, "p").collect())


def test_constant_feature_and_clashing_names(spark):
    rows = _rows(spark, 100).withColumn("c", F.lit(3.0)).withColumn("x", F.lit("kept")).withColumn("m0", F.lit(1))
    scored = ML.score(train_on_physics_loss(rows, FEATURES, "y"), rows, "p")
    assert scored.where((F.col("p") > 0) & (F.col("p") < 1) & (F.col("x") == "kept")).count() == 100


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_missing_values_fail(spark, bad):
    rows = _rows(spark, 20).union(spark.createDataFrame([(bad, 1.0, 1.0, 0.5)], "a double, b double, c double, y double"))
    with pytest.raises(Exception):
        train_on_physics_loss(rows, FEATURES, "y")


def test_descent_crosses_a_curved_valley():
    def valley(at):
        x, y = at
        return float((1 - x) ** 2 + 100 * (y - x * x) ** 2), np.array([-2 * (1 - x) - 400 * x * (y - x * x), 200 * (y - x * x)])

    at, loss, converged = descend(valley, np.array([-1.2, 1.0]), PhysicsFitConfig(tolerance=1e-8))
    assert converged and loss < 1e-10 and at == pytest.approx([1.0, 1.0], abs=1e-4)


def test_no_rows_have_no_loss(spark):
    table = spark.createDataFrame([], "x array<double>, y double")
    loss, gradient = loss_and_gradient(table, np.zeros(3), 0.1)
    assert loss == 0.0 and not gradient.any()
