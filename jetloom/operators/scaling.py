"""Feature scaling fitted by aggregation and applied as column arithmetic."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jetloom.functions.moments import deviation
from jetloom.operators.distribution import exact_quantiles

METHODS = ("robust", "standard", "minmax")


@dataclass(frozen=True)
class ScalerFit:
    """Center and scale per feature: ``scaled = (x - center) / scale``."""

    method: str
    parameters: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        """Scale the fitted columns in place."""
        return df.withColumns(
            {f: (F.col(f) - F.lit(c)) / F.lit(s) for f, (c, s) in self.parameters.items()}
        )

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        """Undo :meth:`transform`."""
        return df.withColumns(
            {f: F.col(f) * F.lit(s) + F.lit(c) for f, (c, s) in self.parameters.items()}
        )

    def save(self, spark, path: str) -> None:
        """Write the parameters as a small table."""
        rows = [(self.method, f, c, s) for f, (c, s) in self.parameters.items()]
        table = spark.createDataFrame(rows, "method string, feature string, center double, scale double")
        table.coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str) -> "ScalerFit":
        """Read parameters written by :meth:`save` (one row per feature)."""
        rows = spark.read.parquet(path).collect()
        return ScalerFit(rows[0]["method"], {r["feature"]: (r["center"], r["scale"]) for r in rows})


class FeatureScaler:
    """Fit a robust, standard or min-max scaling and apply it to other tables."""

    def __init__(self, method: str = "robust", ranges: int | None = None):
        if method not in METHODS:
            raise ValueError(f"Unknown scaling method: {method}")
        self.method = method
        self.ranges = ranges
        self.fitted: ScalerFit | None = None

    def fit(self, df: DataFrame, columns: Sequence[str]) -> ScalerFit:
        """Learn center and scale of each column (a constant column gets scale 1)."""
        columns = list(columns)
        if self.method == "robust":
            found = self._quartiles(df, columns)
        else:
            found = self._moments(df, columns)
        self.fitted = ScalerFit(self.method, {f: (c, s if s else 1.0) for f, (c, s) in found.items()})
        return self.fitted

    def fit_transform(self, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        """Fit on ``df`` and return it scaled."""
        return self.fit(df, columns).transform(df)

    def transform(self, df: DataFrame) -> DataFrame:
        """Scale with the fitted parameters."""
        return self._require().transform(df)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        """Undo the fitted scaling."""
        return self._require().inverse_transform(df)

    def _require(self) -> ScalerFit:
        if self.fitted is None:
            raise ValueError("scaler is not fitted yet: call fit or fit_transform first")
        return self.fitted

    def _quartiles(self, df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
        # Three numbers per feature reach the driver, whatever the table size.
        rows = exact_quantiles(df, columns, (0.25, 0.5, 0.75), self.ranges).collect()
        q = {(r["series"], r["q"]): r["value"] for r in rows}
        if any(q.get((c, 0.5)) is None for c in columns):
            raise ValueError("cannot fit a scaler on an empty table")
        return {c: (q[c, 0.5], q[c, 0.75] - q[c, 0.25]) for c in columns}

    def _moments(self, df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
        if self.method == "standard":
            center, spread = F.avg, deviation
        else:
            center, spread = F.min, lambda c: F.max(c) - F.min(c)
        row = df.agg(
            *[center(F.col(c)).cast("double").alias(f"c_{c}") for c in columns],
            *[spread(F.col(c)).cast("double").alias(f"s_{c}") for c in columns],
        ).first()
        if any(row[f"c_{c}"] is None for c in columns):
            raise ValueError("cannot fit a scaler on an empty table")
        return {c: (row[f"c_{c}"], row[f"s_{c}"]) for c in columns}
