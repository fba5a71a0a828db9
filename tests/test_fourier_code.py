"""The non-linear code: features against numpy, a circle and its centre, saving, missing values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from jetloom.operators.anomaly import AnomalyDetector, draw_frequencies, fourier_error, fourier_features


def test_features_and_error_equal_numpy(spark):
    rng = np.random.default_rng(3)
    x, frequencies = rng.normal(size=(50, 3)), draw_frequencies(3, 16, 7)
    phi = np.cos(x @ frequencies[:, :3].T + frequencies[:, 3]) * math.sqrt(2 / 16)
    center = phi.mean(axis=0)
    axes = np.linalg.svd(phi - center)[2][:4]
    left = (phi - center) - (phi - center) @ axes.T @ axes
    rows = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "i int, v array<double>")
    got = rows.select("i", fourier_features(F.col("v"), frequencies).alias("p"), fourier_error(F.col("v"), frequencies, center, axes).alias("e"))
    for r in got.collect():
        assert r.p == pytest.approx(phi[r.i].tolist(), abs=1e-12)
        assert r.e == pytest.approx((left[r.i] ** 2).sum(), abs=1e-12)


def test_dot_products_approach_the_kernel(spark):
    frequencies = draw_frequencies(2, 20_000, 1)
    a, b = np.array([0.3, -0.5, 1.0]), np.array([1.0, 0.4, 1.0])
    dot = (np.cos(frequencies @ a) * np.cos(frequencies @ b)).mean() * 2
    assert dot == pytest.approx(math.exp(-((a - b) ** 2).sum() / 2), abs=0.02)


@pytest.fixture(scope="module")
def circle(spark):
    points = [(k, math.cos(k), math.sin(k)) for k in range(1, 1500)]
    detector = AnomalyDetector("fourier")
    detector.fit(spark.createDataFrame(points, "event_id long, a double, b double"), ["a", "b"])
    return detector


def _scores(spark, detector, rows):
    scored = detector.detect(spark.createDataFrame(rows, "event_id long, a double, b double"))
    return {r.event_id: (r.anomaly_score, r.is_anomaly) for r in scored.collect()}


def test_centre_of_a_circle_stands_out(spark, circle):
    on = [(k, math.cos(k + 0.5), math.sin(k + 0.5)) for k in range(1, 400)]
    got = _scores(spark, circle, [(0, 0.0, 0.0), *on])
    assert got[0][1] and got[0][0] > 2 * max(score for k, (score, _) in got.items() if k)
    # The linear code rebuilds two columns fully, the centre included.
    linear = AnomalyDetector("reconstruction")
    linear.fit(spark.createDataFrame(on, "event_id long, a double, b double"), ["a", "b"])
    assert _scores(spark, linear, [(0, 0.0, 0.0)])[0][0] == pytest.approx(0.0, abs=1e-12)


def test_saved_detector_scores_alike(spark, circle, tmp_path):
    rows = [(k, k / 10, 1 - k / 10) for k in range(10)]
    circle.save(spark, str(tmp_path / "d"))
    assert _scores(spark, AnomalyDetector.load(spark, str(tmp_path / "d")), rows) == _scores(spark, circle, rows)


def test_missing_values_have_no_score(spark, circle):
    got = _scores(spark, circle, [(1, None, 0.5), (2, float("nan"), 0.5), (3, float("inf"), 0.5), (4, 1.0, 0.0)])
    assert got[1] == (None, False) and not got[2][1] and not got[3][1] and got[4][0] is not None


def test_repeated_rows_and_one_feature(spark):
    rows = spark.createDataFrame([(k, float(k % 3)) for k in range(90)], "event_id long, a double")
    detector = AnomalyDetector("fourier")
    detector.fit(rows, ["a"])
    assert detector.detect(rows).where(F.col("anomaly_score") > 1e-9).count() == 0
