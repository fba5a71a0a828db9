"""Binned performance and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from jetloom.functions.moments import deviation
from jetloom.operators.metrics import r2

MIN_BIN_COUNT = 10


def _bin_index(x: Column, edges: Sequence[float]) -> Column:
    """Half-open bin number of x, null outside the edges (the last edge is outside)."""
    last = len(edges) - 2
    inner = F.array(*[F.lit(float(e)) for e in edges[1:-1]])
    inside = (x >= F.lit(float(edges[0]))) & (x < F.lit(float(edges[-1])))
    passed = F.size(F.filter(inner, lambda e: e <= x)) if last else F.lit(0)
    return F.when(inside, passed)


def binned_performance(
    pairs: DataFrame, bins: Sequence[float] | None = None, n_bins: int = 10
) -> DataFrame:
    """Error metrics per truth bin; every bin is listed, sparse ones with NaN metrics."""
    edges = list(bins) if bins is not None else [i / n_bins for i in range(n_bins + 1)]
    if len(edges) < 2 or any(a >= b for a, b in zip(edges, edges[1:])):
        raise ValueError("bin edges must increase and enclose at least one bin")
    truth, pred = F.col("y_true"), F.col("y_pred")
    err = pred - truth
    spread = deviation(truth)
    found = (
        pairs.withColumn("bin", _bin_index(truth, edges))
        .where(F.col("bin").isNotNull())
        .groupBy("bin")
        .agg(
            F.count(F.lit(1)).alias("bin_count"),
            r2(truth, pred).alias("bin_r2"),
            F.sqrt(F.avg(err * err)).alias("bin_rmse"),
            F.avg(F.abs(err)).alias("bin_mae"),
            F.avg(err).alias("bin_bias"),
            F.when(spread > 0, F.try_divide(deviation(pred), spread)).alias("bin_std_ratio"),
        )
    )
    grid = pairs.sparkSession.createDataFrame(
        [(i, float(a), float(b), (a + b) / 2.0) for i, (a, b) in enumerate(zip(edges, edges[1:]))],
        TY.StructType(
            [TY.StructField("bin", TY.IntegerType())]
            + [TY.StructField(n, TY.DoubleType()) for n in ("bin_low", "bin_high", "bin_center")]
        ),
    )
    count = F.coalesce("bin_count", F.lit(0).cast("bigint"))
    populated = count > MIN_BIN_COUNT
    nan = F.lit(float("nan"))
    measured = ("bin_r2", "bin_rmse", "bin_mae", "bin_bias", "bin_std_ratio")
    # The found side has at most one row per listed bin.
    return grid.join(F.broadcast(found), "bin", "left").select(
        F.col("bin").cast("bigint").alias("bin"),
        "bin_low",
        "bin_high",
        "bin_center",
        count.alias("bin_count"),
        *[F.when(populated, F.coalesce(F.col(m), nan)).otherwise(nan).alias(m) for m in measured],
    )


def density_histogram(df: DataFrame, columns: Sequence[str], n_bins: int = 50) -> DataFrame:
    """Equal-width density histogram of each column over its own range, last bin closed.

    Bins run over [min, max] per series (a constant series gets a unit-wide range) and
    empty bins are listed. NULL and NaN belong to no bin and no total.
    """
    df = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns])
    limits = df.agg(
        *[F.min(c).cast("double").alias(f"lo_{c}") for c in columns],
        *[F.max(c).cast("double").alias(f"hi_{c}") for c in columns],
        *[F.count(c).alias(f"n_{c}") for c in columns],
    ).first()
    spark = df.sparkSession
    ranges = {}
    for c in columns:
        lo, hi = limits[f"lo_{c}"], limits[f"hi_{c}"]
        if lo is None:
            continue
        ranges[c] = (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)
    if not ranges:
        raise ValueError("no values to histogram")

    def bin_of(c: str) -> Column:
        lo, hi = ranges[c]
        offset = F.floor((F.col(c).cast("double") - F.lit(lo)) / F.lit((hi - lo) / n_bins))
        # ``least`` skips NULL, so a missing value would land in the last bin.
        return F.when(F.col(c).isNotNull(), F.least(offset, F.lit(n_bins - 1).cast("bigint")))

    filled = (
        df.select(*[bin_of(c).alias(c) for c in ranges])
        .unpivot([], list(ranges), "series", "bin")
        .where(F.col("bin").isNotNull())
        .groupBy("series", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = spark.createDataFrame(
        [
            (c, i, lo + i * (hi - lo) / n_bins, (hi - lo) / n_bins, limits[f"n_{c}"])
            for c, (lo, hi) in ranges.items()
            for i in range(n_bins)
        ],
        "series string, bin bigint, bin_low double, width double, total bigint",
    )
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    # One row per listed bin on either side.
    return grid.join(F.broadcast(filled), ["series", "bin"], "left").select(
        "series",
        "bin",
        "bin_low",
        (F.col("bin_low") + F.col("width")).alias("bin_high"),
        n.alias("n"),
        (n / (F.col("total") * F.col("width"))).alias("density"),
    )


def cumulative_histogram(df: DataFrame, columns: Sequence[str], n_bins: int = 100) -> DataFrame:
    """Running share of each series up to the end of every bin (at most n_bins rows each)."""
    histogram = density_histogram(df, columns, n_bins)
    upto = Window.partitionBy("series").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("series")
    return histogram.select(
        "series",
        "bin",
        "bin_low",
        "bin_high",
        (F.sum("n").over(upto) / F.sum("n").over(whole)).alias("cumulative"),
    )
