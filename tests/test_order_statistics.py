"""Order statistics by refinement against numpy, with few buckets so that many passes are needed."""

import math

import numpy as np
import pytest

from jetloom.operators import order_statistics as OS

QS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


def values(kind):
    rng = np.random.default_rng(3)
    if kind == "heavy tails":
        return np.concatenate([rng.standard_cauchy(800) * 10.0 ** rng.integers(-280, 270, 800), [1.7e308, 1.1e308, -1.6e308, 5e-324, 0.0, -0.0]])
    if kind == "close together":
        return 1.0 + rng.integers(0, 500, 900) * 2.0**-52
    if kind == "one hot value":
        return np.concatenate([np.full(700, 2.5), rng.normal(2.5, 1e-6, 300)])
    return rng.normal(size=1000)


@pytest.mark.parametrize("kind", ["heavy tails", "close together", "one hot value", "normal"])
@pytest.mark.parametrize("buckets, few", [(40, 0), (65_536, 100)])
def test_quantiles_against_numpy(spark, kind, buckets, few):
    x = values(kind)
    df = spark.createDataFrame([(float(v), float(-v)) for v in x], "a double, b double").repartition(5)
    found = {(s, q): v for s, q, v in OS.interpolated(df, ["a", "b"], QS, buckets, few)}
    for name, column in (("a", np.sort(x)), ("b", np.sort(-x))):
        for q in QS:
            at = (len(x) - 1) * q
            low = math.floor(at)
            want = column[low] + (at - low) * (column[low + 1] - column[low]) if at > low else column[low]
            assert found[name, q] == pytest.approx(want, rel=1e-12, abs=0)


def test_positions_of_extremes_and_gaps(spark):
    x = [None, math.nan, -math.inf, math.inf, 3.0, -2.0, math.inf, math.nan, 0.0]
    df = spark.createDataFrame([(v, None) for v in x], "a double, b double")
    got = OS.order_statistics(df, {"a": range, "b": range}, 4, 0)
    assert [got["a"][k] for k in range(6)] == [-math.inf, -2.0, 0.0, 3.0, math.inf, math.inf]
    assert all(math.isnan(got["a"][k]) for k in (6, 7)) and "b" not in got
    assert OS.interpolated(df.where("false"), ["a"], QS) == []


def test_few_rows_leave_a_pass(spark, monkeypatch):
    """What a pass hands to the driver is bounded by the buckets, not by the distinct values."""
    sizes = []
    counted = OS._counted

    def noted(*args):
        out = counted(*args)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(OS, "_counted", noted)
    df = spark.range(200_000).selectExpr("sqrt(id) AS a", "CAST(id % 7 AS DOUBLE) AS b")
    found = {(s, q): v for s, q, v in OS.interpolated(df, ["a", "b"], [0.5], 100, 50)}
    assert found["b", 0.5] == 3.0 and found["a", 0.5] == pytest.approx((math.sqrt(99_999) + math.sqrt(100_000)) / 2)
    assert max(sizes) < 250
