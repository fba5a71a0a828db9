"""Sensitivity of a model and the profile of its extreme predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jetloom.functions.moments import deviation
from jetloom.session import stage


def prediction_sensitivity(
    model: PipelineModel, rows: DataFrame, features: Sequence[str], perturbation: float = 0.1
) -> DataFrame:
    """(feature, mean_sensitivity): mean absolute response to scaling one feature.

    Every row is expanded to one copy per feature in the same stage and scored in a
    single pass; the averages combine map-side before the shuffle.
    """
    regressor = model.stages[-1]
    values = F.array(*[F.col(f).cast("double") for f in features])
    base = rows.select(values.alias("_x"), array_to_vector(values).alias("features"))
    baseline = regressor.transform(base).select("_x", F.col("prediction").alias("_baseline"))
    shifted = baseline.select(
        "_baseline", "_x", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))).alias("_i")
    ).select(
        "_baseline",
        "_i",
        array_to_vector(
            F.transform(
                "_x", lambda v, i: F.when(i == F.col("_i"), v + v * F.lit(perturbation)).otherwise(v)
            )
        ).alias("features"),
    )
    names = F.array(*[F.lit(f) for f in features])
    response = F.abs(F.col("prediction") - F.col("_baseline")) / F.lit(perturbation)
    return (
        regressor.transform(shifted)
        .groupBy("_i")
        .agg(F.avg(response).alias("mean_sensitivity"))
        .select(F.get(names, F.col("_i")).alias("feature"), "mean_sensitivity")
    )


def extreme_rows(rows: DataFrame, prediction: str, n: int = 10, key: str = "event_id") -> DataFrame:
    """The n highest and n lowest predictions with their side, ties by id; the input runs once."""
    return _ends(stage(rows), prediction, n, key)


def _ends(rows: DataFrame, prediction: str, n: int, key: str) -> DataFrame:
    high = rows.orderBy(F.desc(prediction), F.desc(key)).limit(n)
    low = rows.orderBy(F.asc(prediction), F.asc(key)).limit(n)
    return high.withColumn("side", F.lit("high")).unionByName(low.withColumn("side", F.lit("low")))


def extreme_profile(
    rows: DataFrame, prediction: str, features: Sequence[str], n: int = 10, key: str = "event_id"
) -> DataFrame:
    """Per feature: mean and deviation of the extremes, and their distance to the mean."""
    keep = stage(rows.select(key, prediction, *features))
    extremes = _ends(keep, prediction, n, key)

    def on(side: str, f: str) -> Column:
        return F.when(F.col("side") == side, F.col(f).cast("double"))

    def tall(row: DataFrame, prefixes: Sequence[str]) -> DataFrame:
        entries = [
            F.struct(
                F.lit(f).alias("feature"), *[F.col(f"{p}__{f}").alias(p) for p in prefixes]
            )
            for f in features
        ]
        return row.select(F.inline(F.array(*entries)))

    statistics = {"mean": F.avg, "std": deviation}
    ends = extremes.agg(
        *[
            fn(on(side, f)).alias(f"{side}_{stat}__{f}")
            for side in ("high", "low")
            for stat, fn in statistics.items()
            for f in features
        ]
    )
    overall = keep.agg(*[F.avg(F.col(f).cast("double")).alias(f"overall_mean__{f}") for f in features])
    profile = tall(ends, ["high_mean", "high_std", "low_mean", "low_std"])
    return profile.join(tall(overall, ["overall_mean"]), "feature").select(
        "feature",
        "high_mean",
        "high_std",
        "low_mean",
        "low_std",
        (F.col("high_mean") - F.col("overall_mean")).alias("high_vs_overall"),
        (F.col("low_mean") - F.col("overall_mean")).alias("low_vs_overall"),
    )
