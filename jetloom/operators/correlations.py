"""Feature correlation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jetloom.functions.interpretation import interpret_correlation
from jetloom.functions.moments import correlation
from jetloom.operators.features import numeric_columns


def _correlate(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, r) rows; all coefficients come from one aggregation."""
    y = F.col(target).cast("double")
    wide = df.agg(*[correlation(F.col(f).cast("double"), y).alias(f) for f in features])
    return wide.unpivot([], list(features), "feature", "r")


def feature_target_correlations(
    df: DataFrame,
    target: str,
    features: Sequence[str] | None = None,
    mutual_information: DataFrame | None = None,
) -> DataFrame:
    """Correlation of each numeric feature with the target, strongest first.

    The mutual-information column is 0 unless a (feature, score) table is supplied.
    """
    chosen = list(features) if features is not None else numeric_columns(df)
    chosen = [f for f in chosen if f != target]
    table = _correlate(df, chosen, target)
    if mutual_information is None:
        table = table.withColumn("mutual_information", F.lit(0.0))
    else:
        scores = mutual_information.select("feature", F.col("score").alias("mutual_information"))
        table = table.join(scores, "feature", "left")
    return table.select(
        "feature",
        F.col("r").alias("pearson_correlation"),
        F.abs("r").alias("abs_correlation"),
        "mutual_information",
    ).orderBy(F.desc("abs_correlation"), "feature")


def feature_prediction_correlations(
    df: DataFrame, prediction: str, features: Sequence[str]
) -> DataFrame:
    """Correlation of each feature with the prediction, with its reading in words."""
    table = _correlate(df, features, prediction)
    return table.select(
        "feature",
        F.col("r").alias("correlation_with_cos_theta"),
        F.abs("r").alias("abs_correlation"),
        interpret_correlation(F.col("feature"), F.col("r")).alias("physics_interpretation"),
    ).orderBy(F.desc("abs_correlation"), "feature")


def top_ranked(table: DataFrame, by: Column | str, n: int | None = None) -> DataFrame:
    """A (feature, ...) table ranked by a score, ties by name; optionally the first n."""
    score = F.col(by) if isinstance(by, str) else by
    ranked = table.orderBy(score.desc(), "feature")
    return ranked if n is None else ranked.limit(n)
