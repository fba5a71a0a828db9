"""CDF, quantile and rank kernel against NumPy brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from jetloom.functions.pvalues import beta_fraction, chi2_quantile, correlation_pvalue_of
from jetloom.operators import distribution as D


def make(spark, a, b, partitions=5):
    rows = list(zip(map(float, a), map(float, b)))
    return spark.createDataFrame(rows, "a double, b double").repartition(partitions)


def brute_ks_w(a, b):
    grid = np.unique(np.concatenate([a, b]))
    f = np.searchsorted(np.sort(a), grid, side="right") / len(a)
    g = np.searchsorted(np.sort(b), grid, side="right") / len(b)
    return np.abs(f - g).max(), (np.abs(f - g)[:-1] * np.diff(grid)).sum()


def brute_ranks(x):
    order = np.sort(x)
    return (np.searchsorted(order, x, "left") + np.searchsorted(order, x, "right") + 1) / 2


def samples(kind):
    rng = np.random.default_rng(11)
    n = 2000
    a = rng.normal(0.4, 0.2, n)
    b = a * 1.1 + rng.normal(0, 0.1, n)
    if kind == "ties":
        return np.round(a, 1), np.round(b, 1)
    if kind == "hot":  # one value holds a third of the rows
        a[: n // 3] = 0.25
        b[: n // 2] = 0.5
        return a, b
    if kind == "constant":
        return np.full(50, 2.0), np.arange(50.0)
    return a, b


@pytest.mark.parametrize("kind", ["smooth", "ties", "hot"])
@pytest.mark.parametrize("partitions, ranges", [(1, 2), (7, 5), (16, 64)])
def test_against_numpy(spark, kind, partitions, ranges):
    a, b = samples(kind)
    df = make(spark, a, b, partitions)
    got = D.two_sample_distances(D.joint_cdf(df, "a", "b", ranges)).first()
    ks, w = brute_ks_w(a, b)
    assert got["kolmogorov_smirnov_statistic"] == pytest.approx(ks, abs=1e-12)
    assert got["wasserstein_distance"] == pytest.approx(w, rel=1e-9)

    qs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    found = {(r["series"], r["q"]): r["value"] for r in D.exact_quantiles(df, ["a", "b"], qs, ranges).collect()}
    for name, x in (("a", a), ("b", b)):
        np.testing.assert_allclose([found[name, q] for q in qs], np.quantile(x, qs), rtol=1e-12)

    rho = D.spearman(df, "a", "b", ranges).first()["spearman_correlation"]
    assert rho == pytest.approx(np.corrcoef(brute_ranks(a), brute_ranks(b))[0, 1], abs=1e-9)


def test_self_and_shift(spark):
    a, _ = samples("smooth")
    same = D.two_sample_distances(D.joint_cdf(make(spark, a, a), "a", "b")).first()
    assert same["kolmogorov_smirnov_statistic"] == 0 and same["wasserstein_distance"] == 0
    assert same["kolmogorov_smirnov_pvalue"] == 1.0
    moved = D.two_sample_distances(D.joint_cdf(make(spark, a, a + 0.75), "a", "b")).first()
    assert moved["wasserstein_distance"] == pytest.approx(0.75)


def test_degenerate_inputs(spark):
    a, b = samples("constant")
    assert D.spearman(make(spark, a, b), "a", "b").first()["spearman_correlation"] is None
    one = spark.createDataFrame([(3.0, 4.0)], "a double, b double")
    assert {r["value"] for r in D.exact_quantiles(one, ["a"], [0.1, 0.9]).collect()} == {3.0}
    holes = spark.createDataFrame([(1.0, None), (3.0, 5.0)], "a double, b double")
    found = {r["series"]: r["value"] for r in D.exact_quantiles(holes, ["a", "b"], [0.5]).collect()}
    assert found == {"a": 2.0, "b": 5.0}
    with_inf = spark.createDataFrame([(1.0,), (float("inf"),), (2.0,)], "a double")
    assert D.exact_quantiles(with_inf, ["a"], [0.5]).first()["value"] == 2.0


def test_no_single_task_window(spark):
    a, b = samples("smooth")
    table = D.joint_table(make(spark, a, b), "a", "b")
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(series" in plan and "SinglePartition" not in plan


def test_rank_lookup_spreads_hot_values(spark):
    """A third of the rows share one value, yet no shuffled task gets more than its part."""
    rng = np.random.default_rng(2)
    a = rng.normal(size=6000)
    a[:2000] = 0.5
    pairs = D.stage(D.distinct_pairs(make(spark, a, rng.normal(size=6000)), "a", "b"))
    table = D.stage(D.joint_table(pairs, "a", "b", None, "times"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranked = D._attach_rank(pairs, table, "a", "n_a", F.col("b"), "rank")
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        assert plan.count("_salt") > 0 and "_salt#" in plan.split("Exchange hashpartitioning(")[1].split("ENSURE")[0]
        sizes = ranked.groupBy(F.spark_partition_id()).agg(F.sum("times").alias("n")).collect()
        assert max(r["n"] for r in sizes) < 2600  # 6000 rows over 4 partitions
        assert ranked.where(F.col("rank").isNull()).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_pvalues():
    # Reference values from closed forms: I_x(1/2, 1/2) = 2/pi * asin(sqrt(x)).
    for x in (0.1, 0.5, 0.9):
        assert beta_fraction(0.5, 0.5, x) == pytest.approx(2 / np.pi * np.arcsin(np.sqrt(x)), rel=1e-10)
    # With 4 pairs the correlation p-value is 1 - |r|.
    assert correlation_pvalue_of(0.3, 4) == pytest.approx(0.7, rel=1e-10)
    assert correlation_pvalue_of(1.0, 10) == 0.0
    assert np.isnan(correlation_pvalue_of(0.5, 2))
    # Two degrees of freedom: the chi-square quantile is -2 ln(1 - p).
    assert chi2_quantile(0.975, 2) == pytest.approx(-2 * np.log(0.025), rel=1e-9)


def test_kolmogorov_tail(spark):
    df = spark.createDataFrame([(0.1, 100, 100)], "d double, n int, m int")
    p = df.select(D.kolmogorov_pvalue(F.col("d"), F.col("n"), F.col("m"))).first()[0]
    lam = 0.1 * np.sqrt(50)
    assert p == pytest.approx(2 * sum((-1) ** (k - 1) * np.exp(-2 * k * k * lam**2) for k in range(1, 60)))
