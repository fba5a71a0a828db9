"""Regressors of cos(theta*) on Spark ML, scoring, importance and persistence."""

from __future__ import annotations

import logging
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jetloom.operators.boosting import Booster
from jetloom.operators.metrics import r2
from jetloom.session import checkpoint_root, stage, stage_path

log = logging.getLogger(__name__)

#: Rounds of the first run of boosting: enough to see whether a single tree already fits without error.
FIRST_ROUNDS = 10


@dataclass(frozen=True)
class BoostedTreesConfig:
    """Boosting parameters; the defaults are fixed values of the standard training."""

    max_depth: int = 6
    learning_rate: float = 0.1
    rounds: int = 1000
    subsample: float = 0.8
    feature_share: float = 0.8
    seed: int = 42
    checkpoint_every: int = 10
    patience: int = 50
    partition_rows: int = 50_000


def _assembler(features: Sequence[str]) -> VectorAssembler:
    # Invalid rows fail the job: dropping them silently would lose events.
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")


def patience_cut(errors: Sequence[float], patience: int) -> tuple[int, bool]:
    """Number of the best round before ``patience`` rounds passed without a better one, and whether they have passed.

    An error of zero cannot be bettered and counts as waited out.
    """
    best, lowest = 0, math.inf
    for number, error in enumerate(errors, 1):
        if error < lowest:
            best, lowest = number, error
        elif number - best >= patience:
            return best, True
    return best, lowest == 0


def _few_partitions(rows: DataFrame, size: int) -> DataFrame:
    """``rows``, staged, in no more partitions than their number asks for or cores can take at once.

    Every level of a tree is a job over all partitions, so beyond one wave more of them only cost time.
    """
    rows = stage(rows)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    wanted = max(1, min(-(-rows.count() // size), cores))
    return rows.coalesce(wanted) if wanted < rows.rdd.getNumPartitions() else rows


def next_rounds(rounds: int, best: int, config: BoostedTreesConfig) -> int:
    """Length of the run that follows one of ``rounds`` whose best is ``best``.

    Errors that still fall after the patience seldom stop soon: such a run goes on to the last round at once. Others are
    doubled.
    """
    if rounds >= config.patience and best == rounds:
        return config.rounds
    return min(config.rounds, max(2 * rounds, config.patience + FIRST_ROUNDS))


def train_boosted_trees(
    rows: DataFrame,
    features: Sequence[str],
    target: str,
    validation: str | None = None,
    config: BoostedTreesConfig = BoostedTreesConfig(),
) -> PipelineModel:
    """Boosted regression trees; ``validation`` names a boolean column for early stopping (NULL means training).

    With validation rows, boosting ends when ``config.patience`` rounds have not lowered their squared error, and the
    model is cut back to its best round. The error of every round is measured in one pass over the validation rows.
    Training goes in growing runs: a run that has not waited out its patience goes on as a longer one
    (:func:`next_rounds`), without repeating a round.
    """
    checkpoint_root(rows.sparkSession)  # many rounds cut their lineage there
    assembler = _assembler(features)

    trees = GBTRegressor(
        featuresCol="features",
        labelCol=target,
        predictionCol="prediction",
        maxDepth=config.max_depth,
        stepSize=config.learning_rate,
        maxIter=config.rounds,
        subsamplingRate=config.subsample,
        featureSubsetStrategy=str(config.feature_share),
        seed=config.seed,
        checkpointInterval=config.checkpoint_every,
    )
    if validation is None:
        return PipelineModel([assembler, trees.fit(assembler.transform(rows))])

    held = F.coalesce(F.col(validation), F.lit(False))
    columns = dict.fromkeys([*features, target])
    training = assembler.transform(_few_partitions(rows.where(~held).select(*columns), config.partition_rows))
    held_out = assembler.transform(_few_partitions(rows.where(held).select(*columns), config.partition_rows))
    rounds = min(FIRST_ROUNDS, config.rounds)
    boosting = Booster(trees, training, held_out, features, target)
    while True:
        errors = boosting.run(rounds, config.patience)
        best, waited = patience_cut(errors, config.patience)
        log.info("boosting: best of %d rounds is %d, validation mse %g", rounds, best, errors[best - 1] if best else math.nan)
        if waited or rounds >= config.rounds:
            break
        rounds = next_rounds(rounds, best, config)
    # Without validation rows there is no best round: all are kept.
    return PipelineModel([assembler, boosting.model(best or len(errors))])


def train_bounded(
    rows: DataFrame,
    features: Sequence[str],
    target: str,
    max_iter: int = 25,
    regularization: float = 1e-6,
) -> PipelineModel:
    """Regression with a logistic output: predictions cannot leave [0, 1].

    A fit that meets ``max_iter`` is reported as a warning: it may not have converged.
    """
    head = GeneralizedLinearRegression(
        featuresCol="features",
        labelCol=target,
        predictionCol="prediction",
        family="binomial",
        link="logit",
        maxIter=max_iter,
        regParam=regularization,
    )
    model = Pipeline(stages=[_assembler(features), head]).fit(rows)
    steps = model.stages[-1].summary.numIterations
    if steps >= max_iter:
        log.warning("bounded regressor stopped after %d iterations, possibly before it converged", steps)
    return model


def regression_metrics(scored: DataFrame, target: str, prediction: str = "prediction") -> DataFrame:
    """Validation mse, mae, r2 and rmse, one row."""
    truth, pred = F.col(target), F.col(prediction)
    err = truth - pred
    return scored.agg(
        F.avg(err * err).alias("val_mse"),
        F.avg(F.abs(err)).alias("val_mae"),
        r2(truth, pred).alias("val_r2"),
        F.sqrt(F.avg(err * err)).alias("val_rmse"),
    )


def score(model: PipelineModel, rows: DataFrame, output: str = "predicted_cos_theta_star") -> DataFrame:
    """Add the prediction column; ids and all other columns stay on the row."""
    scored = model.transform(rows).withColumnRenamed("prediction", output)
    return scored.drop("features")


def score_all(models: Mapping[str, PipelineModel], rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """One prediction column per model; a model that cannot run on ``rows`` is skipped."""
    out, used = rows, []
    for name, model in models.items():
        try:
            out = score(model, out, name)
        except Exception as problem:  # e.g. a feature column this model needs is missing
            log.warning("skipping model %s: %s", name, problem)
            continue
        used.append(name)
    return out, used


def split_counts(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """(feature, importance): how often each feature splits a node, zeros included."""
    spark = _session()
    path = stage_path(spark, "trees")
    model.stages[-1].write().overwrite().save(path)
    index = F.col("nodeData.split.featureIndex")
    counted = (
        spark.read.parquet(f"{path}/data")
        .where(index >= 0)
        .groupBy(index.alias("index"))
        .agg(F.count(F.lit(1)).alias("importance"))
    )
    names = spark.createDataFrame(list(enumerate(features)), "index int, feature string")
    return (
        names.join(counted, "index", "left")
        .select("feature", F.coalesce("importance", F.lit(0).cast("bigint")).alias("importance"))
        .orderBy(F.desc("importance"), "feature")
    )


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def save_model(model: PipelineModel, path: str, metadata: Mapping[str, str] | None = None) -> None:
    """Write a fitted pipeline and, next to it, its metadata as a small table."""
    model.write().overwrite().save(f"{path}/model")
    rows = sorted((str(k), str(v)) for k, v in (metadata or {}).items())
    table = _session().createDataFrame(rows, "key string, value string")
    table.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_model(path: str) -> tuple[PipelineModel, dict[str, str]]:
    """Read what :func:`save_model` wrote."""
    table = _session().read.schema("key string, value string").json(f"{path}/metadata")
    return PipelineModel.load(f"{path}/model"), {r["key"]: r["value"] for r in table.collect()}
