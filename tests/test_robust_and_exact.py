"""Robust covariance under clustered contamination, and the exact two-sample p-value."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from jetloom.functions import pvalues as P
from jetloom.operators import anomaly as AN
from jetloom.operators.distribution import joint_cdf, two_sample_distances


def clustered(spark, share, d=3, n=2000):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, d))
    bad = int(share * n)
    x[:bad] = 12 + 0.05 * rng.normal(size=(bad, d))
    return x, bad, spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(4)


@pytest.mark.parametrize("share", [0.0, 0.1, 0.3])
def test_a_tight_cluster_does_not_hold_the_estimate(spark, share):
    x, bad, rows = clustered(spark, share)
    mean, cov = AN.robust_covariance(rows, "v")
    assert np.abs(mean).max() < 0.2
    assert np.abs(cov - np.eye(3)).max() < 0.35
    distance = ((x - mean) @ np.linalg.inv(cov) * (x - mean)).sum(axis=1)
    if bad:
        assert distance[:bad].min() > 5 * distance[bad:].max()


@pytest.mark.parametrize("share", [0.3, 0.4])
def test_many_starts_reach_at_least_the_determinant_of_the_clean_half(spark, share):
    """Beyond a third, a tight cluster with its nearest rows can be the densest half itself; it then has to be found."""
    x, bad, _ = clustered(spark, share)
    found = AN.sample_starts(x, 100, 5, 1)
    heights = [AN._log_det(c) for _, c in found]
    assert heights == sorted(heights) and len(found) <= 5
    good = x[bad:]
    half = good[np.argsort((good**2).sum(axis=1))[: (len(x) + 4) // 2]]
    assert heights[0] <= AN._log_det(np.cov(half.T, bias=True))


def test_concentration_of_several_estimates_in_one_pass(spark):
    x, _, rows = clustered(spark, 0.3)
    starts = [(np.zeros(3), np.eye(3)), (np.full(3, 12.0), np.eye(3))]
    together = AN.concentrate(rows, "v", starts, 0.5)
    for (mean, cov), (own_mean, own_cov) in zip(together, (AN.concentrate(rows, "v", [s], 0.5)[0] for s in starts)):
        assert np.allclose(mean, own_mean) and np.allclose(cov, own_cov)
    half = x[np.argsort((x**2).sum(axis=1))[:1000]]
    assert np.allclose(together[0][0], half.mean(axis=0), atol=0.01)


def test_columns_without_variance_and_repeated_rows(spark):
    rows = spark.createDataFrame([([float(i % 7), 2.0, float(i % 7) * 3],) for i in range(300)], "v array<double>")
    mean, cov = AN.robust_covariance(rows, "v")
    assert np.isfinite(mean).all() and np.isfinite(cov).all() and abs(cov[1, 1]) < 1e-12


def brute(far, n, m):
    """Share of all merged orders whose greatest gap |i m - j n| is ``far`` or more."""
    hit = total = 0
    for chosen in itertools.combinations(range(n + m), n):
        i = j = gap = 0
        for k in range(n + m):
            i, j = (i + 1, j) if k in chosen else (i, j + 1)
            gap = max(gap, abs(i * m - j * n))
        hit += gap >= far
        total += 1
    return hit / total


@pytest.mark.parametrize("n, m", [(1, 1), (1, 6), (3, 5), (4, 4), (6, 4), (7, 7), (8, 5)])
def test_exact_pvalue_equals_enumeration(n, m):
    for far in range(0, n * m + 1, math.gcd(n, m)):
        assert P.exact_kolmogorov_pvalue_of(far / (n * m), n, m) == pytest.approx(brute(far, n, m), abs=1e-12)


@pytest.mark.parametrize("n, far", [(50, 9), (500, 70), (500, 400), (3000, 60)])
def test_exact_pvalue_of_equal_sizes(n, far):
    def term(k):
        return math.exp(2 * math.lgamma(n + 1) - math.lgamma(n - k * far + 1) - math.lgamma(n + k * far + 1))

    closed = 2 * sum((-1) ** (k + 1) * term(k) for k in range(1, n // far + 1))
    assert P.exact_kolmogorov_pvalue_of(far / n, n, n) == pytest.approx(closed, rel=1e-8)


def test_pvalue_column_is_exact_up_to_its_bound_and_null_safe(spark):
    rows = spark.createDataFrame([(0.5, 8, 8), (0.02, 10_001, 10_001), (None, None, None)], "d double, n long, m long")
    got = [r[0] for r in rows.select(P.kolmogorov_pvalue(F.col("d"), F.col("n"), F.col("m"))).collect()]
    assert got[0] == pytest.approx(brute(32, 8, 8))
    assert got[1] == rows.limit(2).select(P.asymptotic_kolmogorov_pvalue(F.col("d"), F.col("n"), F.col("m"))).collect()[1][0]
    assert got[2] is None
    pairs = spark.createDataFrame([(float(i), float(i) + 2.5) for i in range(7)], "a double, b double")
    found = two_sample_distances(joint_cdf(pairs, "a", "b")).first()
    far = round(found["kolmogorov_smirnov_statistic"] * 49)
    assert found["kolmogorov_smirnov_pvalue"] == pytest.approx(brute(far, 7, 7))


def test_concentration_cuts_are_exact_on_many_rows(spark, monkeypatch):
    """Cuts found by bucket counts are the wanted order statistic, with ties, whatever the first guess was."""
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(60_000, 3)), 2)
    x[:20_000] = x[0]
    rows = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(5)
    monkeypatch.setattr(AN, "CANDIDATES", 50)
    blocks = AN._blocks(rows, "v")
    estimates = [(np.zeros(3), np.eye(3)), (x[0], np.eye(3) * 4.0), (np.full(3, 9.0), np.diag([1.0, 2.0, 0.0]))]
    for sample in (None, x[::40], x[:200] + 50):
        for share in (0.1, 0.50005, 1.0):
            found = AN._below(blocks, estimates, AN._brackets(blocks, estimates, share, sample))
            for (mean, cov), (cut, n, new_mean, new_cov) in zip(estimates, found):
                distance = (((x - mean) @ AN._whitener(cov).T) ** 2).sum(axis=1)
                want = np.sort(distance)[math.ceil(share * len(x)) - 1]
                near = x[distance <= want * (1 + 1e-12)]
                assert cut == pytest.approx(want, rel=1e-12) and n == len(near)
                assert np.allclose(new_mean, near.mean(axis=0)) and np.allclose(new_cov, np.cov(near.T, bias=True))


def test_a_concentration_step_sorts_and_repeats_no_rows(spark):
    """Rows are neither multiplied by the estimates nor shuffled: a step is two passes over packed blocks."""
    _, _, rows = clustered(spark, 0.3)
    blocks = AN._blocks(rows, "v")
    assert blocks.count() < 50
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    kept, mean, cov = AN._within(blocks, (np.zeros(3), np.eye(3)), 7.8)
    x = np.array([r[0] for r in rows.collect()])
    near = x[(x**2).sum(axis=1) < 7.8]
    assert kept == len(near) and np.allclose(mean, near.mean(axis=0)) and np.allclose(cov, np.cov(near.T, bias=True))


def test_distance_of_missing_vectors_is_missing(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 0.0]), (5, [0.0, 3.0])], "i int, v array<double>")
    scored = rows.select("i", AN.mahalanobis(F.col("v"), np.zeros(2), np.diag([1.0, 4.0])).alias("d")).orderBy("i").collect()
    d = [r.d for r in scored]
    assert d[0] == pytest.approx(2.0) and d[1] is None and d[2] is None and math.isnan(d[3]) and d[4] == pytest.approx(2.25)


def test_steps_go_on_while_the_determinant_falls(spark, monkeypatch):
    """More than ten steps: starts that meet go on as one, until a step no longer lowers the determinant."""
    steps = []

    def concentrated(blocks, estimates, core, sample):
        steps.append(len(estimates))
        return [(np.zeros(2), np.eye(2) * max(2.0 ** -len(steps), 2.0**-15))] * len(estimates)

    monkeypatch.setattr(AN, "_concentrated", concentrated)
    AN.robust_covariance(spark.range(100).select(F.array(F.rand(1), F.rand(2)).alias("v")), "v")
    assert len(steps) == 16 and steps[1:] == [1] * 15
