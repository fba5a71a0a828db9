"""Metric battery, bins, histograms, correlations, interpretation tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from jetloom.operators import binned as H
from jetloom.operators import correlations as C
from jetloom.operators import interpret as I
from jetloom.operators import metrics as M


def make(spark, true, pred, partitions=4):
    rows = [(i, float(t), float(p)) for i, (t, p) in enumerate(zip(true, pred))]
    return spark.createDataFrame(rows, "event_id bigint, y_true double, y_pred double").repartition(partitions)


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(3)
    true = np.round(rng.beta(3, 1.5, 1500), 3)
    return true, true * 1.05 + rng.normal(0, 0.05, 1500)


def test_battery_against_numpy(spark, arrays):
    t, p = arrays
    rows = M.evaluate_predictions(make(spark, t, p)).collect()
    got = {r["metric"]: r["value"] for r in rows}
    assert len(rows) == len(got) == 56
    sse = ((t - p) ** 2).sum()
    expected = {
        "r2_score": 1 - sse / ((t - t.mean()) ** 2).sum(),
        "rmse": math.sqrt(sse / len(t)),
        "mae": np.abs(t - p).mean(),
        "mape": np.abs((t - p) / (t + 1e-8)).mean() * 100,
        "forward_fraction_true_80": (t > 0.8).mean(),
        "forward_difference_90": abs((t > 0.9).mean() - (p > 0.9).mean()),
        "std_ratio": p.std() / t.std(),
        "skewness_pred": ((p - p.mean()) ** 3).mean() / p.std() ** 3,
        "kurtosis_true": ((t - t.mean()) ** 4).mean() / t.var() ** 2 - 3,
        "quantile_95_pred": np.quantile(p, 0.95),
        "quantile_10_difference": abs(np.quantile(t, 0.1) - np.quantile(p, 0.1)),
        "fraction_in_bounds_pred": ((p >= 0) & (p <= 1)).mean(),
        "out_of_bounds_penalty": (np.maximum(0, -p) + np.maximum(0, p - 1)).sum(),
        "pearson_correlation": np.corrcoef(t, p)[0, 1],
    }
    for name, value in expected.items():
        assert got[name] == pytest.approx(value, rel=1e-9), name
    score = 2 * got["forward_difference_80"] + got["mean_difference"] + 0.5 * got["kolmogorov_smirnov_statistic"]
    assert got["qcd_consistency_score"] == pytest.approx(score)


def test_perfect_and_constant_truth(spark):
    same = M.moment_metrics(make(spark, [0.5] * 5, [0.5] * 5)).first()
    assert same["r2_score"] == 1.0 and same["std_ratio"] is None
    off = M.moment_metrics(make(spark, [0.5] * 5, [0.6] * 5)).first()
    assert off["r2_score"] == 0.0
    assert M.pearson(make(spark, [0.5] * 5, [0.1, 0.2, 0.3, 0.4, 0.5])).first()["pearson_correlation"] is None


def test_nan_predictions_do_not_pass_thresholds(spark):
    row = M.constraint_satisfaction(make(spark, [0.5, 0.5], [float("nan"), 0.9])).first()
    assert row["bounds_violation_rate"] == 0.0 and row["forward_scattering_fraction"] == 0.5


def test_bins(spark):
    t = [0.05] * 10 + [0.15] * 10 + [0.19] + [1.0] * 20
    p = [x + 0.01 for x in t]
    rows = {r["bin"]: r for r in H.binned_performance(make(spark, t, p)).collect()}
    assert len(rows) == 10
    assert rows[0]["bin_count"] == 10 and math.isnan(rows[0]["bin_mae"])  # needs more than 10
    assert rows[1]["bin_count"] == 11 and rows[1]["bin_mae"] == pytest.approx(0.01)
    assert rows[1]["bin_bias"] == pytest.approx(0.01) and rows[1]["bin_std_ratio"] == pytest.approx(1.0)
    assert rows[9]["bin_count"] == 0  # 1.0 falls outside the last bin
    custom = H.binned_performance(make(spark, t, p), bins=[0.0, 0.1, 2.0]).orderBy("bin").collect()
    assert [r["bin_count"] for r in custom] == [10, 31]
    with pytest.raises(ValueError):
        H.binned_performance(make(spark, t, p), bins=[1.0, 0.0])


def test_constant_bin(spark):
    rows = H.binned_performance(make(spark, [0.15] * 12, [0.15] * 12)).where("bin = 1").first()
    assert rows["bin_r2"] == 1.0 and math.isnan(rows["bin_std_ratio"])


def test_histograms(spark, arrays):
    t, p = arrays
    rows = H.density_histogram(make(spark, t, p), ["y_true", "y_pred"], 20).orderBy("series", "bin").collect()
    for name, x in (("y_true", t), ("y_pred", p)):
        n, _ = np.histogram(x, bins=20)
        mine = [r for r in rows if r["series"] == name]
        # Values on an inner edge may fall on either side by rounding.
        assert sum(r["n"] for r in mine) == len(x)
        assert np.abs(np.cumsum([r["n"] for r in mine]) - np.cumsum(n)).max() <= 5
        assert sum(r["density"] * (r["bin_high"] - r["bin_low"]) for r in mine) == pytest.approx(1.0)
    last = H.cumulative_histogram(make(spark, t, p), ["y_true"], 10).where("bin = 9").first()
    assert last["cumulative"] == 1.0
    flat = H.density_histogram(make(spark, [2.0] * 3, [1.0] * 3), ["y_true"], 4).collect()
    assert sum(r["n"] for r in flat) == 3


def test_mass_spectrum(spark):
    rows = [(float(500 + i),) for i in range(1, 200)]
    df = spark.createDataFrame(rows, "mjj double")
    heavy = M.validate_mass_spectrum(df, weight=F.lit(1e14) * F.pow("mjj", F.lit(-4.5))).first()
    assert heavy["power_law_slope"] == pytest.approx(-4.5, abs=1e-3) and heavy["slope_consistent"]
    flat = M.validate_mass_spectrum(df).first()
    assert flat["power_law_r_squared"] == 0.0 and not flat["slope_consistent"]
    few = M.validate_mass_spectrum(df.limit(100)).first()
    assert few["insufficient_high_mass_events"] and few["power_law_slope"] is None


def test_angular_validation_and_models(spark, arrays):
    t, p = arrays
    pairs = make(spark, t, p)
    row = M.validate_angular(pairs, truth="y_true").first()
    assert row["forward_scattering_deviation"] == pytest.approx(abs((p > 0.8).mean() - 0.6))
    assert row["ks_statistic"] > 0 and "ks_statistic" not in M.validate_angular(pairs).columns
    models = M.validate_models(M.to_model_rows(pairs, ["y_true", "y_pred"])).collect()
    assert {r["model"] for r in models} == {"y_true", "y_pred"}


def test_physics_loss(spark, arrays):
    t, p = arrays
    row = M.physics_loss(make(spark, t, p), 0.1).first()
    expected = (
        ((p - t) ** 2).mean()
        + 0.1 * (np.maximum(-p, 0).mean() + np.maximum(p - 1, 0).mean())
        + 0.01 * np.maximum(0.2 - p, 0).mean()
        + 0.005 * max(0.01 - p.var(ddof=1), 0)
    )
    assert row["total_loss"] == pytest.approx(expected)


def test_panels(spark, arrays):
    panels = M.validation_panels(M.evaluate_predictions(make(spark, *arrays))).collect()
    assert len(panels) == 4 + 3 + 7 + 4
    assert {r["status"] for r in panels if r["panel"] == "scores"} <= {"green", "orange", "red"}


def test_correlations(spark, arrays):
    t, p = arrays
    df = make(spark, t, p).withColumns({"flat": F.lit(1.0), "name": F.lit("x")})
    table = C.feature_target_correlations(df, "y_true").collect()
    assert [r["feature"] for r in table][0] == "y_pred" and "name" not in [r["feature"] for r in table]
    assert table[-1]["feature"] == "flat" and table[-1]["pearson_correlation"] is None
    assert all(r["mutual_information"] == 0.0 for r in table)
    assert [r["feature"] for r in C.top_ranked(C.feature_target_correlations(df, "y_true"), "abs_correlation", 1).collect()] == ["y_pred"]


def test_extremes(spark):
    df = make(spark, np.arange(50.0), np.arange(50.0)).withColumn("f", F.col("y_true") * 2)
    sides = I.extreme_rows(df, "y_pred", 3).groupBy("side").agg(F.sort_array(F.collect_list("y_pred")).alias("v"))
    assert {r["side"]: r["v"] for r in sides.collect()} == {"high": [47.0, 48.0, 49.0], "low": [0.0, 1.0, 2.0]}
    row = I.extreme_profile(df, "y_pred", ["f"], 3).first()
    assert row["high_mean"] == 96.0 and row["high_vs_overall"] == pytest.approx(47.0)
    assert row["low_std"] == pytest.approx(np.std([0.0, 2.0, 4.0]))
