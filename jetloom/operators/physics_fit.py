"""A bounded regressor fitted on the physics-informed loss, which Spark ML does not offer.

The model is that of :func:`jetloom.operators.models.train_bounded`, a logistic function of the features; the loss is
:func:`jetloom.operators.metrics.physics_loss`: squared error, values outside [0, 1], low values and a sample variance
that is too small. All of it, gradient included, follows from sums over rows, so every evaluation is one pass: tasks turn
Arrow batches into a few sums per feature, and only those are shuffled. L-BFGS moves the parameters, one number per
feature and an intercept, on the driver.
"""

from __future__ import annotations

import logging
from collections import deque
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import GeneralizedLinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jetloom.functions.moments import deviation
from jetloom.operators.models import train_bounded
from jetloom.session import stage

log = logging.getLogger(__name__)

#: Fixed values of the loss: lowest wanted prediction, least wanted variance, and the shares of the physics weight.
LOW, SPREAD = 0.2, 0.01
LOW_SHARE, SPREAD_SHARE = 0.1, 0.05
#: Sums that do not belong to a feature: rows, squared error, prediction, squared prediction, shortfall below LOW.
PLAIN = 5


@dataclass(frozen=True)
class PhysicsFitConfig:
    """``tolerance`` bounds the largest component of the gradient (features have deviation 1) and the relative gain of a step."""

    physics_weight: float = 0.1
    max_iter: int = 200
    tolerance: float = 1e-9
    memory: int = 10


def _sums(theta: np.ndarray, weight: float):
    """Sums of a partition at the parameters ``theta`` (intercept first), as rows ``(position, value)``."""

    def run(batches):
        d = len(theta)
        total = np.zeros(PLAIN + 3 * d)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.ones((batch.num_rows, d))
            x[:, 1:] = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d - 1)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            z = x @ theta
            # exp of a negative number only, so that no side overflows.
            small = np.exp(-np.abs(z))
            p = np.where(z >= 0, 1.0, small) / (1.0 + small)
            slope = small / (1.0 + small) ** 2
            below = np.maximum(LOW - p, 0.0)
            total[:PLAIN] += len(y), ((p - y) ** 2).sum(), p.sum(), (p * p).sum(), below.sum()
            pull = 2.0 * (p - y) - LOW_SHARE * weight * (below > 0)
            for i, part in enumerate((pull * slope, p * slope, slope)):
                at = PLAIN + i * d
                total[at : at + d] += part @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["position", "value"])

    return run


def loss_and_gradient(rows: DataFrame, theta: np.ndarray, weight: float) -> tuple[float, np.ndarray]:
    """Loss of ``rows(x array<double>, y double)`` and its gradient, in one pass. Predictions cannot leave [0, 1]."""
    d = len(theta)
    parts = rows.select("x", "y").mapInArrow(_sums(theta, weight), "position int, value double")
    sums = np.zeros(PLAIN + 3 * d)
    for position, value in parts.groupBy("position").agg(F.sum("value")).collect():
        sums[position] = value
    n, squared, p, pp, below = sums[:PLAIN]
    if n == 0:
        return 0.0, np.zeros(d)
    pull, with_p, plain = sums[PLAIN:].reshape(3, d)
    loss, gradient = squared / n + weight * LOW_SHARE * below / n, pull / n
    # A single row has no sample variance and no such penalty.
    if n > 1:
        missing = SPREAD - max(pp - p * p / n, 0.0) / (n - 1)
        if missing > 0:
            share = weight * SPREAD_SHARE
            loss += share * missing
            gradient = gradient - share * 2.0 * (with_p - p / n * plain) / (n - 1)
    return float(loss), gradient


def _direction(gradient: np.ndarray, steps: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Descent direction from the last steps ``(moved, gradient change)``, oldest first."""
    q, shares = gradient.copy(), []
    for moved, change in reversed(steps):
        share = moved @ q / (moved @ change)
        q -= share * change
        shares.append(share)
    if steps:
        moved, change = steps[-1]
        q *= (moved @ change) / (change @ change)
    for (moved, change), share in zip(steps, reversed(shares), strict=True):
        q += (share - change @ q / (moved @ change)) * moved
    return -q


def descend(
    evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], theta: np.ndarray, config: PhysicsFitConfig
) -> tuple[np.ndarray, float, bool]:
    """Parameters, loss and whether the descent has converged; the loss never exceeds that of the start.

    Every trial costs one evaluation, and nearly every step is the first trial.
    """
    loss, gradient = evaluate(theta)
    steps: deque[tuple[np.ndarray, np.ndarray]] = deque(maxlen=config.memory)
    for number in range(config.max_iter):
        if np.abs(gradient).max() <= config.tolerance:
            return theta, loss, True
        direction = _direction(gradient, steps)
        fall = direction @ gradient
        size = 1.0 if steps else 1.0 / max(1.0, np.abs(gradient).sum())
        while True:
            reached, slope = evaluate(theta + size * direction)
            if reached <= loss + 1e-4 * size * fall:
                break
            size /= 2.0
            if size < 1e-10:
                break
        if reached > loss or size < 1e-10:
            if not steps:
                return theta, loss, True
            # Old steps mislead near a kink of the loss: go on along the gradient.
            steps.clear()
            continue
        moved, change = size * direction, slope - gradient
        if moved @ change > 1e-12 * np.sqrt((moved @ moved) * (change @ change)):
            steps.append((moved, change))
        gain, theta, loss, gradient = loss - reached, theta + moved, reached, slope
        log.info("physics loss after step %d: %g", number + 1, loss)
        if gain <= config.tolerance * 1e-4 * max(loss, 1e-12):
            return theta, loss, True
    return theta, loss, False


def train_on_physics_loss(
    rows: DataFrame, features: Sequence[str], target: str, config: PhysicsFitConfig = PhysicsFitConfig()
) -> PipelineModel:
    """The bounded regressor with the least physics loss that descends from the fit of :func:`train_bounded`.

    Its loss on ``rows`` is at most that of this start. The result scores, saves and loads like every other model.
    A NULL or NaN feature or target, or a target outside [0, 1], fails the job; a constant feature keeps its start
    weight; equal rows count each; other columns are ignored; without rows the start itself raises. A fit that meets
    ``config.max_iter`` is reported as a warning.
    """
    used = stage(rows.select(*[F.col(f).cast("double").alias(f) for f in dict.fromkeys([*features, target])]))
    start = train_bounded(used, features, target)
    head = start.stages[-1]
    spread = used.agg(*[c for i, f in enumerate(features) for c in (F.avg(f).alias(f"m{i}"), deviation(F.col(f)).alias(f"s{i}"))]).first()
    d = len(features)
    center = np.array([spread[f"m{i}"] for i in range(d)])
    scale = np.array([spread[f"s{i}"] or 1.0 for i in range(d)])
    free = np.array([bool(spread[f"s{i}"]) for i in range(d)])
    scaled = F.array(*[(F.col(f) - F.lit(float(center[i]))) / F.lit(float(scale[i])) for i, f in enumerate(features)])
    table = stage(used.select(scaled.alias("x"), F.col(target).alias("y")))

    weights = np.array(head.coefficients.toArray())
    theta = np.concatenate([[head.intercept + weights @ center], weights * scale])
    theta, loss, converged = descend(lambda at: loss_and_gradient(table, at, config.physics_weight), theta, config)
    if not converged:
        log.warning("physics loss %g after %d iterations, possibly before it converged", loss, config.max_iter)
    fitted = np.where(free, theta[1:] / scale, weights)
    intercept = float(theta[0] - fitted @ center)

    sc = rows.sparkSession.sparkContext
    java = sc._jvm.org.apache.spark.ml.regression.GeneralizedLinearRegressionModel(
        head.uid, _py2java(sc, DenseVector(fitted)), intercept
    )
    return PipelineModel([start.stages[0], head._copyValues(GeneralizedLinearRegressionModel(java))])
