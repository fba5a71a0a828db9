"""NULL and NaN rules of caps, histograms, information scores, detectors and p-values."""

import math

import pytest

from jetloom.functions.pvalues import correlation_pvalue_of
from jetloom.operators.anomaly import AnomalyDetector
from jetloom.operators.binned import density_histogram
from jetloom.operators.feature_selection import mutual_information_scores
from jetloom.operators.topk import first_by_key


def test_null_keys_come_last_at_every_size(spark):
    df = spark.createDataFrame([(None,)] + [(k,) for k in range(1000)], "k long")
    for size in (10, 100, 1000):
        assert sorted(r.k for r in first_by_key(df, "k", size).collect()) == list(range(size))


def test_histogram_leaves_nan_out(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (float("nan"),), (None,), (0.9,)], "x double")
    rows = {r.bin: r.n for r in density_histogram(df, ["x"], 2).collect()}
    assert rows == {0: 1, 1: 2}


def test_information_ignores_missing_cells(spark):
    full = [(float(k % 10), float((k * 7919) % 101)) for k in range(600)]
    holes = [(None if y < 50 else x, y) for x, y in full] + [(float("nan"), 3.0)]
    schema = "x double, y double"
    score = {
        name: mutual_information_scores(spark.createDataFrame(rows, schema), ["x"], "y", bins=4).first().score
        for name, rows in (("holes", holes), ("clean", [r for r in full if r[1] >= 50]))
    }
    assert abs(score["holes"] - score["clean"]) < 0.1


def test_rows_without_a_score_are_not_flagged(spark):
    rows = [(k, float(k % 17), float(k % 13)) for k in range(400)]
    detector = AnomalyDetector("reconstruction")
    detector.fit(spark.createDataFrame(rows, "event_id long, a double, b double"), ["a", "b"])
    odd = spark.createDataFrame([(1, float("nan"), 1.0), (2, None, 1.0), (3, 1.0, 900.0)], "event_id long, a double, b double")
    flags = {r.event_id: r.is_anomaly for r in detector.detect(odd).collect()}
    assert flags[1] is False and flags[2] is False


@pytest.mark.parametrize("n", [10**7, 10**9, 10**12])
def test_correlation_pvalue_at_scale(n):
    r = 1.0 / math.sqrt(n)
    assert correlation_pvalue_of(r, n) == pytest.approx(math.erfc(1 / math.sqrt(2)), rel=1e-6)
    assert correlation_pvalue_of(0.0, n) == 1.0
