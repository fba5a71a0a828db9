"""Scores and K-best selection of features for the target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jetloom.functions.moments import correlation
from jetloom.operators.correlations import top_ranked
from jetloom.operators.distribution import exact_quantiles
from jetloom.session import stage

MI_BINS = 16


def f_scores(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, score): F statistic of the univariate linear fit, one aggregation."""
    y = F.col(target).cast("double")
    row = df.agg(
        F.count(F.lit(1)).alias("_n"), *[correlation(F.col(f).cast("double"), y).alias(f) for f in features]
    )
    long = row.unpivot(["_n"], list(features), "feature", "r")
    r2 = F.col("r") * F.col("r")
    return long.select(
        "feature", F.try_divide(r2 * (F.col("_n") - 2), F.lit(1.0) - r2).alias("score")
    )


def _edges(df: DataFrame, columns: Sequence[str], bins: int, ranges: int | None) -> dict[str, list[float]]:
    inner = [i / bins for i in range(1, bins)]
    rows = exact_quantiles(df, columns, inner, ranges).collect()
    found: dict[str, list[tuple[float, float]]] = {c: [] for c in columns}
    for r in rows:
        found[r["series"]].append((r["q"], r["value"]))
    return {c: [v for _, v in sorted(found[c])] for c in columns}


def _bucket(x: Column, edges: list[float]) -> Column:
    """Quantile bucket; NULL and NaN, and columns without any value, have none."""
    if not edges or any(e is None for e in edges):
        return F.lit(None).cast("int")
    return F.when(x.isNotNull() & ~F.isnan(x), F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= x)))


def mutual_information_scores(
    df: DataFrame, features: Sequence[str], target: str, bins: int = MI_BINS, ranges: int | None = None
) -> DataFrame:
    """(feature, score): mutual information (nats) on quantile buckets.

    The contingency table has at most bins*bins cells per feature, counted with map-side
    combine; marginals are sums over its cells.
    """
    edges = _edges(df, [*features, target], bins, ranges)
    bucketed = df.select(
        _bucket(F.col(target).cast("double"), edges[target]).alias("_y"),
        *[_bucket(F.col(f).cast("double"), edges[f]).alias(f) for f in features],
    )
    cells = (
        bucketed.unpivot(["_y"], list(features), "feature", "_x")
        .where("_x IS NOT NULL AND _y IS NOT NULL")
        .groupBy("feature", "_x", "_y")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    by_feature = cells.groupBy("feature").agg(
        F.collect_list(F.struct("_x", "_y", "n")).alias("cells")  # at most bins*bins entries
    )
    total = F.aggregate("cells", F.lit(0).cast("bigint"), lambda acc, c: acc + c["n"])
    prepared = by_feature.select("feature", "cells", total.alias("total"))

    def marginal(side: str, value: Column) -> Column:
        return F.aggregate(
            F.filter("cells", lambda c: c[side] == value),
            F.lit(0).cast("bigint"),
            lambda acc, c: acc + c["n"],
        )

    score = F.aggregate(
        F.transform(
            F.array_sort("cells"),
            lambda c: c["n"]
            / F.col("total")
            * F.ln(c["n"] * F.col("total") / (marginal("_x", c["_x"]) * marginal("_y", c["_y"]))),
        ),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )
    return prepared.select("feature", score.alias("score"))


def tree_importance_scores(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    num_trees: int = 100,
    max_depth: int = 8,
    seed: int = 42,
) -> DataFrame:
    """(feature, score): impurity importance of a random forest.

    Every row counts: a NULL or NaN feature lies below all known values of its column.
    """
    known = {f: F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) for f in features}
    df = stage(df.select(target, *features))
    lowest = df.agg(*[F.coalesce(F.min(c), F.lit(0.0)).alias(f) for f, c in known.items()]).first()
    below_all = {f: lowest[f] - max(1.0, abs(lowest[f])) for f in features}
    filled = df.select(target, *[F.coalesce(c, F.lit(below_all[f])).alias(f) for f, c in known.items()])
    assembled = VectorAssembler(inputCols=list(features), outputCol="features").transform(filled)
    forest = RandomForestRegressor(
        featuresCol="features",
        labelCol=target,
        numTrees=num_trees,
        maxDepth=max_depth,
        seed=seed,
        featureSubsetStrategy="all",
    ).fit(assembled.select("features", target))
    scores = forest.featureImportances.toArray()
    return df.sparkSession.createDataFrame(
        [(f, float(s)) for f, s in zip(features, scores)], "feature string, score double"
    )


SCORERS = {
    "mutual_info": mutual_information_scores,
    "f_regression": f_scores,
    "tree_importance": tree_importance_scores,
}


class FeatureSelector:
    """Keep the k best-scoring features."""

    def __init__(self, method: str = "mutual_info", k: int = 15, **options):
        if method not in SCORERS:
            raise ValueError(f"Unknown selection method: {method}")
        self.method, self.k, self.options = method, k, options
        self.scores: DataFrame | None = None
        self.selected: list[str] | None = None

    def fit(self, df: DataFrame, features: Sequence[str], target: str) -> "FeatureSelector":
        """Score the features and remember the k best, in input order."""
        scores = SCORERS[self.method](df, list(features), target, **self.options)
        rows = scores.collect()  # one row per feature
        self.scores = df.sparkSession.createDataFrame(rows, scores.schema)
        ordered = sorted(rows, key=lambda r: (-_finite(r["score"]), r["feature"]))
        best = {r["feature"] for r in ordered[: self.k]}
        self.selected = [f for f in features if f in best]
        return self

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Only the kept columns and the selected features."""
        return df.select(*keep, *self._require(self.selected))

    def ranking(self) -> DataFrame:
        """All features by score, best first."""
        return top_ranked(self._require(self.scores), "score")

    @staticmethod
    def _require(value):
        if value is None:
            raise ValueError("feature selection not performed yet: call fit first")
        return value


def _finite(score: float | None) -> float:
    return score if score is not None and score == score else float("-inf")
