"""Exact order statistics by refinement: count buckets, look closer only where a wanted position lies.

One aggregation counts every column in buckets of an increasing function of the value and notes the smallest and largest value of
each bucket. The bucket that holds a wanted position becomes the next, narrower range; all wanted positions of all columns are
refined by the same scan. What is shuffled and reaches the driver is a bounded number of buckets, never the distinct values,
however many rows there are. When few rows are left in the ranges, their values are counted one by one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jetloom.session import stage

#: Buckets that a pass counts over all ranges together.
BUCKETS = 65_536
#: Rows in all ranges together whose values are counted one by one.
FEW_ROWS = 50_000
_HUGE = 1e280


@dataclass
class _Range:
    """Values of one column from ``low`` to ``high``: ``before`` rows are smaller, ``count`` rows lie inside."""

    series: str
    low: float
    high: float
    before: int
    count: int
    wanted: list[int] = field(default_factory=list)

    @property
    def single(self) -> bool:
        return self.low == self.high or (math.isnan(self.low) and math.isnan(self.high))


def _magnitude(x: Column) -> Column:
    """An increasing whole number for any double: quarter octaves of both signs, extremes on their own; NaN is largest."""
    octave = F.signum(x) * F.log2(1 + F.abs(x) * F.lit(2.0**60))
    return (
        F.when(F.isnan(x), F.lit(30_000))
        .when(x == math.inf, F.lit(20_000)).when(x == -math.inf, F.lit(-20_000))
        .when(x >= _HUGE, F.lit(10_000)).when(x <= -_HUGE, F.lit(-10_000))
        .otherwise(F.floor(octave * 4).cast("int"))
    )


def _counted(buckets: DataFrame, *keys: str) -> DataFrame:
    return buckets.groupBy(*keys, "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")
    )


def _descend(series: str, before: int, wanted: Iterable[int], buckets: Iterable) -> list[_Range]:
    """The buckets, in increasing order, that hold a wanted position."""
    found, rest = [], sorted(wanted)
    for row in sorted(buckets, key=lambda r: r.bucket):
        inside = [p for p in rest if p < before + row.n]
        if inside:
            found.append(_Range(series, row.low, row.high, before, row.n, inside))
            rest = rest[len(inside) :]
        before += row.n
    return found


def order_statistics(df: DataFrame, wanted: Mapping[str, Callable[[int], Iterable[int]]], buckets: int = BUCKETS, few: int = FEW_ROWS) -> dict[str, dict[int, float]]:
    """Values at sorted positions, from 0, of the columns of ``df``; NULLs do not count, NaN is larger than all numbers.

    ``wanted`` maps a column to a function from its number of values to the positions asked for.
    """
    columns = list(wanted)
    long = stage(df.select(*[F.col(c).cast("double").alias(c) for c in columns])).unpivot([], columns, "series", "x")
    long = long.where(F.col("x").isNotNull())
    by_series: dict[str, list] = {}
    for row in _counted(long.withColumn("bucket", _magnitude(F.col("x"))), "series").collect():
        by_series.setdefault(row.series, []).append(row)
    out: dict[str, dict[int, float]] = {}
    active: list[_Range] = []
    for series, rows in by_series.items():
        out[series] = {}
        active += _descend(series, 0, set(wanted[series](sum(r.n for r in rows))), rows)
    while True:
        for r in active:
            if r.single:
                out[r.series].update(dict.fromkeys(r.wanted, r.low))
        active = [r for r in active if not r.single]
        if not active:
            return out
        table = df.sparkSession.createDataFrame(
            [(k, r.series, r.low, r.high) for k, r in enumerate(active)], "range int, series string, low double, high double"
        )
        # A row per wanted position at most.
        inside = long.join(F.broadcast(table), "series").where(F.col("x").between(F.col("low"), F.col("high")))
        if sum(r.count for r in active) <= few:
            bucket = F.col("x")
        else:
            share = max(2, buckets // len(active))
            bucket = F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * share).cast("int")
        by_range: dict[int, list] = {}
        for row in _counted(inside.select("range", "x", bucket.alias("bucket")), "range").collect():
            by_range.setdefault(row.range, []).append(row)
        active = [narrow for k, rows in by_range.items() for narrow in _descend(active[k].series, active[k].before, active[k].wanted, rows)]


def interpolated(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], buckets: int = BUCKETS, few: int = FEW_ROWS) -> list[tuple[str, float, float]]:
    """``(series, q, value)`` by linear interpolation between the two neighbouring positions; a column without values has none."""
    places: dict[str, list[tuple[float, int, float]]] = {}

    def asked(column: str):
        def positions(n: int) -> list[int]:
            places[column] = [(float(q), math.floor((n - 1) * float(q)), (n - 1) * float(q) - math.floor((n - 1) * float(q))) for q in probabilities]
            return [p for _, at, part in places[column] for p in ((at, at + 1) if part else (at,))]

        return positions

    values = order_statistics(df, {c: asked(c) for c in columns}, buckets, few)
    out = []
    for series, at in values.items():
        for q, low, part in places[series]:
            out.append((series, q, at[low] + part * (at[low + 1] - at[low]) if part else at[low]))
    return out
