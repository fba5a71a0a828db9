"""Truth-versus-prediction statistics, correlations, scaling, selection and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from jetloom.functions.kinematics import parton_correction
from jetloom.operators import binned as H
from jetloom.operators import correlations as C
from jetloom.operators import distribution as D
from jetloom.operators import feature_selection as FS
from jetloom.operators import interpret as I
from jetloom.operators import metrics as M
from jetloom.operators.scaling import FeatureScaler
from jetloom.operators.splits import FOLD, MULTIPLIER, PRIME, add_split, training_share
from workloads.base import SQL_TRAINING, SQL_OBS, SQL_PAIRS, observed, pairs, query, rounded, sql_round, steady
from workloads.physics import _TEXT_SQL

# ---------------------------------------------------------------- G: single-pass families

ERR = "(y_true - y_pred)"
R2 = (
    f"CASE WHEN var_pop(y_true) > 0 THEN 1 - sum({ERR}*{ERR}) / (count(*) * var_pop(y_true)) "
    f"WHEN sum({ERR}*{ERR}) = 0 THEN 1.0 ELSE 0.0 END"
)


def _central(c: str, k: int) -> str:
    return f"avg(pow({c} - mu_{c}, {k}))"


def _skew(c: str) -> str:
    return f"{_central(c, 3)} / pow({_central(c, 2)}, 1.5)"


_MU = ", mu AS (SELECT avg(y_true) AS mu_y_true, avg(y_pred) AS mu_y_pred FROM pairs), pm AS (SELECT * FROM pairs, mu)"


def _moments(columns):
    def run(spark, sf_dir):
        return rounded(M.moment_metrics(pairs(spark, sf_dir)).select(*columns))

    return run


_ERRORS = [
    ("r2_score", R2),
    ("mse", f"avg({ERR}*{ERR})"),
    ("rmse", f"sqrt(avg({ERR}*{ERR}))"),
    ("mae", f"avg(abs{ERR})"),
]
query("g1_error_metrics", SQL_PAIRS + f" SELECT {sql_round(_ERRORS)} FROM pairs")(
    _moments([n for n, _ in _ERRORS])
)


@query(
    "g2_mape",
    SQL_PAIRS + " SELECT round(avg(abs((y_true - y_pred) / (y_true + 1e-8))) * 100, 6) AS mape FROM pairs",
)
def g2(spark, sf_dir):
    return rounded(M.moment_metrics(pairs(spark, sf_dir)).select("mape"))


_FORWARD = []
for _t in M.FORWARD_THRESHOLDS:
    _a, _b = (f"avg(CASE WHEN {c} > {_t} THEN 1.0 ELSE 0.0 END)" for c in ("y_true", "y_pred"))
    _k = M.percent(_t)
    _FORWARD += [
        (f"forward_fraction_true_{_k}", _a),
        (f"forward_fraction_pred_{_k}", _b),
        (f"forward_difference_{_k}", f"abs({_a} - {_b})"),
    ]
query("g3_forward_fractions", SQL_PAIRS + f" SELECT {sql_round(_FORWARD)} FROM pairs")(
    _moments([n for n, _ in _FORWARD])
)

_MOMENTS = [
    ("mean_true", "avg(y_true)"),
    ("mean_pred", "avg(y_pred)"),
    ("mean_difference", "abs(avg(y_true) - avg(y_pred))"),
    ("std_true", "stddev_pop(y_true)"),
    ("std_pred", "stddev_pop(y_pred)"),
    ("std_ratio", "stddev_pop(y_pred) / stddev_pop(y_true)"),
]
query("g7_mean_and_std", SQL_PAIRS + f" SELECT {sql_round(_MOMENTS)} FROM pairs")(
    _moments([n for n, _ in _MOMENTS])
)

_SHAPE = [
    ("skewness_true", _skew("y_true")),
    ("skewness_pred", _skew("y_pred")),
    ("kurtosis_true", "kurtosis_pop(y_true)"),
    ("kurtosis_pred", "kurtosis_pop(y_pred)"),
]
query("g8_skewness_kurtosis", SQL_PAIRS + _MU + f" SELECT {sql_round(_SHAPE)} FROM pm")(
    _moments([n for n, _ in _SHAPE])
)

_BOUNDS = [
    ("fraction_in_bounds_true", "avg(CASE WHEN y_true >= 0 AND y_true <= 1 THEN 1.0 ELSE 0.0 END)"),
    ("fraction_in_bounds_pred", "avg(CASE WHEN y_pred >= 0 AND y_pred <= 1 THEN 1.0 ELSE 0.0 END)"),
    ("out_of_bounds_penalty", "sum(greatest(-y_pred, 0.0) + greatest(y_pred - 1, 0.0))"),
]
query("g10_bounds", SQL_PAIRS + f" SELECT {sql_round(_BOUNDS)} FROM pairs")(_moments([n for n, _ in _BOUNDS]))

# ---------------------------------------------------------------- G: distributions

SQL_CDF = (
    SQL_PAIRS
    + """, both_samples AS (SELECT y_true AS x, 1 AS a, 0 AS b FROM pairs UNION ALL SELECT y_pred, 0, 1 FROM pairs),
vals AS (SELECT x, sum(a) AS na, sum(b) AS nb FROM both_samples GROUP BY x),
cdf AS (SELECT x, sum(na) OVER (ORDER BY x) / (SELECT count(*) FROM pairs) AS f,
  sum(nb) OVER (ORDER BY x) / (SELECT count(*) FROM pairs) AS g, lead(x) OVER (ORDER BY x) AS nx FROM vals)"""
)
KS = "max(abs(f - g))"


@query("g4_ks_statistic", SQL_CDF + f" SELECT round({KS}, 6) AS kolmogorov_smirnov_statistic FROM cdf")
def g4(spark, sf_dir):
    cdf = D.joint_cdf(pairs(spark, sf_dir), "y_true", "y_pred")
    return rounded(D.two_sample_distances(cdf).select("kolmogorov_smirnov_statistic"))


@query(
    "g4_ks_pvalue",
    SQL_OBS
    + """, both_samples AS (SELECT leading_jet_phi AS x, 1 AS a, 0 AS b FROM obs UNION ALL SELECT subleading_jet_phi, 0, 1 FROM obs),
vals AS (SELECT x, sum(a) AS na, sum(b) AS nb FROM both_samples GROUP BY x),
cdf AS (SELECT sum(na) OVER (ORDER BY x) / (SELECT count(*) FROM obs) AS f,
  sum(nb) OVER (ORDER BY x) / (SELECT count(*) FROM obs) AS g FROM vals),
lam AS (SELECT max(abs(f - g)) AS d, max(abs(f - g)) * sqrt((SELECT count(*) FROM obs) / 2.0) AS l FROM cdf),
sizes AS (SELECT count(*) AS n FROM obs),
terms AS (SELECT d, CASE WHEN n > 10000 THEN exp(-2.0 * k * k * l * l)
    WHEN k * round(d * n) > n THEN 0.0
    ELSE exp(2 * lgamma(n + 1.0) - lgamma(n - k * round(d * n) + 1.0) - lgamma(n + k * round(d * n) + 1.0)) END
  * CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END AS t FROM lam, sizes, range(1, 101) AS r(k))
SELECT round(max(d), 6) AS kolmogorov_smirnov_statistic, round(least(greatest(sum(t), 0.0), 1.0), 6) AS kolmogorov_smirnov_pvalue FROM terms""",
)
def g4_pvalue(spark, sf_dir):
    # Two azimuths of the same event follow nearly the same law, so the p-value is not 0. Samples of one size up to
    # 10,000 rows have a closed sum over lattice paths; beyond it the value is the asymptotic one.
    cdf = D.joint_cdf(observed(spark, sf_dir), "leading_jet_phi", "subleading_jet_phi")
    return rounded(D.two_sample_distances(cdf).drop("wasserstein_distance"))


@query("g6_wasserstein_distance", SQL_CDF + " SELECT round(sum(abs(f - g) * (nx - x)), 6) AS wasserstein_distance FROM cdf")
def g6(spark, sf_dir):
    cdf = D.joint_cdf(pairs(spark, sf_dir), "y_true", "y_pred")
    return rounded(D.two_sample_distances(cdf).select("wasserstein_distance"))


def _quantile_sql(probabilities) -> str:
    rows = " UNION ALL ".join(
        f"SELECT {q} AS q, quantile_cont(y_true, {q}) AS a, quantile_cont(y_pred, {q}) AS b FROM pairs"
        for q in probabilities
    )
    return (
        SQL_PAIRS
        + f", qs AS ({rows}) SELECT round(CAST(q AS DOUBLE), 2) AS q, "
        + sql_round([("q_true", "a"), ("q_pred", "b"), ("q_difference", "abs(a - b)")])
        + " FROM qs"
    )


@query("g9_quantiles", _quantile_sql(M.QUANTILES))
def g9(spark, sf_dir):
    return rounded(M.quantile_metrics(pairs(spark, sf_dir)))


_GRID = "[" + ", ".join(str(i / 100) for i in range(1, 100)) + "]"


@query(
    "g26_quantile_quantile",
    SQL_PAIRS
    + f", qs AS (SELECT unnest({_GRID}) AS q, unnest(quantile_cont(y_true, {_GRID})) AS a, "
    f"unnest(quantile_cont(y_pred, {_GRID})) AS b FROM pairs) SELECT round(CAST(q AS DOUBLE), 2) AS q, "
    + sql_round([("q_true", "a"), ("q_pred", "b"), ("q_difference", "abs(a - b)")])
    + " FROM qs",
)
def g26(spark, sf_dir):
    return rounded(M.quantile_quantile(pairs(spark, sf_dir)))


@query("g11_pearson", SQL_PAIRS + " SELECT round(corr(y_true, y_pred), 6) AS pearson_correlation, 0.0::DOUBLE AS pearson_pvalue FROM pairs")
def g11(spark, sf_dir):
    return rounded(M.pearson(pairs(spark, sf_dir)))


RANKS = """, ranks AS (SELECT
  rank() OVER (ORDER BY y_true) + (count(*) OVER (PARTITION BY y_true) - 1) / 2.0 AS a,
  rank() OVER (ORDER BY y_pred) + (count(*) OVER (PARTITION BY y_pred) - 1) / 2.0 AS b FROM pairs)"""


@query(
    "g13_spearman",
    SQL_PAIRS + RANKS + " SELECT round(corr(a, b), 6) AS spearman_correlation, 0.0::DOUBLE AS spearman_pvalue FROM ranks",
)
def g13(spark, sf_dir):
    return rounded(D.spearman(pairs(spark, sf_dir), "y_true", "y_pred"))


# Two azimuths of one event: hardly correlated, so that no p-value is 0.
_AZIMUTHS = SQL_OBS + ", pairs AS (SELECT event_id, leading_jet_phi AS y_true, subleading_jet_phi AS y_pred FROM obs)"


def _tail_sql(statistic: str) -> str:
    """CTE ``tail(r, p)`` of ``statistic(r, n)``: the chance of a larger |r| by Simpson's rule on the law of r."""
    weight = "CASE WHEN k IN (0, 1000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    return f"""{statistic}, tail AS (
SELECT r, 1 - 2 * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt(pi()) * abs(r) / 3000.0
  * sum({weight} * pow(1 - r * r * (k / 1000.0) * (k / 1000.0), (n - 4) / 2.0)) AS p
FROM statistic, range(0, 1001) AS t(k) GROUP BY r, n)"""


_PEARSON_TAIL = _tail_sql(", statistic AS (SELECT corr(y_true, y_pred) AS r, count(*) AS n FROM pairs)")
_SPEARMAN_TAIL = _tail_sql(RANKS + ", statistic AS (SELECT corr(a, b) AS r, count(*) AS n FROM ranks)")


def _azimuths(spark, sf_dir):
    return observed(spark, sf_dir).select("event_id", F.col("leading_jet_phi").alias("y_true"), F.col("subleading_jet_phi").alias("y_pred"))


@query("g11_pearson_pvalue", f"{_AZIMUTHS}{_PEARSON_TAIL} SELECT round(r, 6) AS pearson_correlation, round(p, 6) AS pearson_pvalue FROM tail")
def g11_pvalue(spark, sf_dir):
    return rounded(M.pearson(_azimuths(spark, sf_dir)))


@query("g13_spearman_pvalue", f"{_AZIMUTHS}{_SPEARMAN_TAIL} SELECT round(r, 6) AS spearman_correlation, round(p, 6) AS spearman_pvalue FROM tail")
def g13_pvalue(spark, sf_dir):
    return rounded(D.spearman(_azimuths(spark, sf_dir), "y_true", "y_pred"))


@query(
    "g14_battery_correlation_pvalues",
    f"{_AZIMUTHS}{_PEARSON_TAIL.replace('tail', 'tail_r').replace('statistic', 'stat_r')}"
    f"{_SPEARMAN_TAIL.replace('tail', 'tail_s').replace('statistic', 'stat_s')}"
    " SELECT 'pearson_pvalue' AS metric, round(p, 6) AS value FROM tail_r UNION ALL SELECT 'spearman_pvalue', round(p, 6) FROM tail_s",
)
def g14_pvalues(spark, sf_dir):
    battery = M.evaluate_predictions(_azimuths(spark, sf_dir))
    return rounded(battery.where(F.col("metric").isin("pearson_pvalue", "spearman_pvalue")))


_SCORE = dict(_FORWARD)["forward_difference_80"] + " * 2.0 + abs(avg(y_true) - avg(y_pred))"


@query(
    "g14_consistency_score",
    SQL_CDF
    + f" SELECT round((SELECT {_SCORE} FROM pairs) + 0.5 * (SELECT {KS} FROM cdf), 6) AS qcd_consistency_score",
)
def g14(spark, sf_dir):
    battery = M.evaluate_predictions(pairs(spark, sf_dir))
    return rounded(battery.where(F.col("metric") == "qcd_consistency_score").select(F.col("value").alias("qcd_consistency_score")))


def _metric_rows(items, source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS metric, round({e}, 6) + 0.0 AS value FROM {source}" for n, e in items)


_QUANTILE_ROWS = []
for _q in M.QUANTILES:
    for _name, _e in (
        ("true", f"quantile_cont(y_true, {_q})"),
        ("pred", f"quantile_cont(y_pred, {_q})"),
        ("difference", f"abs(quantile_cont(y_true, {_q}) - quantile_cont(y_pred, {_q}))"),
    ):
        _QUANTILE_ROWS.append((f"quantile_{M.percent(_q)}_{_name}", _e))


@query(
    "g14_metric_battery",
    SQL_CDF
    + _MU
    + RANKS
    + " "
    + " UNION ALL ".join(
        [
            _metric_rows(
                [
                    *_ERRORS,
                    ("mape", "avg(abs((y_true - y_pred) / (y_true + 1e-8))) * 100"),
                    *_FORWARD,
                    *_MOMENTS,
                    *_BOUNDS,
                    *_QUANTILE_ROWS,
                    ("pearson_correlation", "corr(y_true, y_pred)"),
                ],
                "pairs",
            ),
            _metric_rows(_SHAPE, "pm"),
            _metric_rows(
                [("kolmogorov_smirnov_statistic", KS), ("wasserstein_distance", "sum(abs(f - g) * (nx - x))")], "cdf"
            ),
            _metric_rows([("spearman_correlation", "corr(a, b)")], "ranks"),
            "SELECT 'qcd_consistency_score' AS metric, "
            f"round((SELECT {_SCORE} FROM pairs) + 0.5 * (SELECT {KS} FROM cdf), 6) AS value",
        ]
    ),
)
def g14_battery(spark, sf_dir):
    battery = M.evaluate_predictions(pairs(spark, sf_dir))
    return rounded(battery.where(~F.col("metric").endswith("_pvalue")))


# ---------------------------------------------------------------- G: bins and histograms

_BIN_SQL = [
    ("bin_r2", R2),
    ("bin_rmse", f"sqrt(avg({ERR}*{ERR}))"),
    ("bin_mae", f"avg(abs{ERR})"),
    ("bin_bias", "avg(y_pred - y_true)"),
    ("bin_std_ratio", "CASE WHEN stddev_pop(y_true) > 0 THEN stddev_pop(y_pred) / stddev_pop(y_true) END"),
]


@query(
    "g15_binned_performance",
    SQL_PAIRS
    + ", grid AS (SELECT CAST(i AS BIGINT) AS bin, i / 10.0 AS lo, (i + 1) / 10.0 AS hi FROM range(0, 10) AS r(i)), "
    "found AS (SELECT bin, count(*) AS n, "
    + ", ".join(f"{e} AS {n}" for n, e in _BIN_SQL)
    + " FROM grid JOIN pairs ON y_true >= lo AND y_true < hi GROUP BY bin HAVING count(*) > 10) "
    "SELECT grid.bin, round(lo, 2)::DOUBLE AS bin_low, round(hi, 2)::DOUBLE AS bin_high, "
    "round((lo + hi) / 2, 2)::DOUBLE AS bin_center, "
    "(SELECT count(*) FROM pairs WHERE y_true >= lo AND y_true < hi) AS bin_count, "
    + ", ".join(f"coalesce(round({n}, 6), 'nan'::DOUBLE) AS {n}" for n, _ in _BIN_SQL)
    + " FROM grid LEFT JOIN found USING (bin)",
)
def g15(spark, sf_dir):
    places = {"bin_low": 2, "bin_high": 2, "bin_center": 2}
    return rounded(H.binned_performance(pairs(spark, sf_dir)), places)


def _histogram_sql(n_bins: int, tail: str) -> str:
    return (
        SQL_PAIRS
        + f""", long AS (SELECT 'y_true' AS series, y_true AS x FROM pairs UNION ALL SELECT 'y_pred', y_pred FROM pairs),
lim AS (SELECT series, min(x) AS lo, (max(x) - min(x)) / {n_bins} AS w, count(*) AS total FROM long GROUP BY series),
filled AS (SELECT series, least(CAST(floor((x - lo) / w) AS BIGINT), {n_bins - 1}) AS bin, count(*) AS n
  FROM long JOIN lim USING (series) GROUP BY 1, 2),
hist AS (SELECT lim.series, CAST(i AS BIGINT) AS bin, lo + i * w AS bin_low, lo + (i + 1) * w AS bin_high,
  coalesce(n, 0) AS n, coalesce(n, 0) / (total * w) AS density, total
  FROM lim CROSS JOIN range(0, {n_bins}) AS r(i) LEFT JOIN filled ON filled.series = lim.series AND filled.bin = i) """
        + tail
    )


@query(
    "g24_density_histogram",
    _histogram_sql(50, f"SELECT series, bin, n, {sql_round(['bin_low', 'bin_high', 'density'])} FROM hist"),
)
def g24(spark, sf_dir):
    return rounded(H.density_histogram(pairs(spark, sf_dir), ["y_true", "y_pred"], 50))


@query(
    "g25_cumulative_histogram",
    _histogram_sql(
        100,
        f"SELECT series, bin, {sql_round(['bin_low', 'bin_high'])}, round(sum(n) OVER (PARTITION BY series "
        "ORDER BY bin) / total, 6) AS cumulative FROM hist",
    ),
)
def g25(spark, sf_dir):
    return rounded(H.cumulative_histogram(pairs(spark, sf_dir), ["y_true", "y_pred"], 100))


# ---------------------------------------------------------------- G: correlations

CORR_FEATURES = ["mjj", "delta_y", "delta_phi", "chi", "pt_balance", "dijet_pt", "eta_centrality", "n_jets"]


def _corr_sql(target: str) -> str:
    return ", corr_rows AS (" + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, corr({f}, {target}) AS r FROM scored" for f in CORR_FEATURES
    ) + ")"


_SCORED = ", scored AS (SELECT *, cos_theta_star*(1+0.1*exp(-mjj/1000.0))*(1+0.05*cos_theta_star) AS y_pred FROM obs)"


def _scored(spark, sf_dir):
    return observed(spark, sf_dir).withColumn("y_pred", parton_correction("cos_theta_star", "mjj"))


@query(
    "g16_feature_target_correlations",
    SQL_OBS
    + _SCORED
    + _corr_sql("cos_theta_star")
    + " SELECT feature, round(r, 6) AS pearson_correlation, round(abs(r), 6) AS abs_correlation, "
    "0.0::DOUBLE AS mutual_information FROM corr_rows",
)
def g16(spark, sf_dir):
    rows = observed(spark, sf_dir)
    return rounded(C.feature_target_correlations(rows, "cos_theta_star", CORR_FEATURES))


@query(
    "g17_feature_prediction_correlations",
    SQL_OBS
    + _SCORED
    + _corr_sql("y_pred")
    + ", signed AS (SELECT feature, r, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS sgn FROM corr_rows)"
    " SELECT feature, round(r, 6) AS correlation_with_cos_theta, round(abs(r), 6) AS abs_correlation, "
    f"{_TEXT_SQL} AS physics_interpretation FROM signed",
)
def g17(spark, sf_dir):
    return rounded(C.feature_prediction_correlations(_scored(spark, sf_dir), "y_pred", CORR_FEATURES))


@query(
    "a5_top_correlated_features",
    SQL_OBS + _SCORED + _corr_sql("cos_theta_star")
    + " SELECT feature, round(abs(r), 6) AS abs_correlation FROM corr_rows ORDER BY abs(r) DESC, feature LIMIT 3",
)
def a5(spark, sf_dir):
    table = C.feature_target_correlations(observed(spark, sf_dir), "cos_theta_star", CORR_FEATURES)
    return rounded(C.top_ranked(table, "abs_correlation", 3).select("feature", "abs_correlation"))


# ---------------------------------------------------------------- G: validators

_FWD = "avg(CASE WHEN y_pred > 0.8 THEN 1.0 ELSE 0.0 END)"


@query(
    "g18_angular_validation",
    SQL_CDF
    + " SELECT "
    + sql_round(
        [
            ("forward_scattering_fraction", _FWD),
            ("forward_scattering_deviation", f"abs({_FWD} - 0.6)"),
            ("mean_cos_theta_star", "avg(y_pred)"),
            ("mean_deviation", "abs(avg(y_pred) - 0.75)"),
            ("qcd_consistency_score", f"abs({_FWD} - 0.6) * 2 + abs(avg(y_pred) - 0.75)"),
            ("ks_statistic", f"(SELECT {KS} FROM cdf)"),
        ]
    )
    + " FROM pairs",
)
def g18(spark, sf_dir):
    return rounded(M.validate_angular(pairs(spark, sf_dir), truth="y_true").drop("ks_pvalue"))


def _spectrum_sql(weight: str) -> str:
    return (
        SQL_OBS
        + f", high AS (SELECT ln(mjj) AS x, ln({weight} + 1e-10) AS y FROM obs WHERE mjj > 500), "
        "fit AS (SELECT count(*) AS n, regr_slope(y, x) AS s, corr(y, x) AS r, var_pop(y) AS v FROM high) "
        "SELECT n AS n_high_mass, n <= 100 AS insufficient_high_mass_events, "
        "CASE WHEN n > 100 THEN round(s, 6) + 0.0 END AS power_law_slope, "
        "CASE WHEN n > 100 THEN CASE WHEN v > 0 THEN round(r * r, 6) ELSE 0.0 END END AS power_law_r_squared, "
        "CASE WHEN n > 100 THEN s > -5 AND s < -4 END AS slope_consistent FROM fit"
    )


@query("g19_mass_spectrum", _spectrum_sql("(1e12 / pow(mjj, 4.5))"))
def g19(spark, sf_dir):
    weight = F.lit(1e12) / F.pow(F.col("mjj"), F.lit(4.5))
    return rounded(M.validate_mass_spectrum(observed(spark, sf_dir), weight=weight))


@query("g19_mass_spectrum_unweighted", _spectrum_sql("1.0::DOUBLE"))
def g19_flat(spark, sf_dir):
    return rounded(M.validate_mass_spectrum(observed(spark, sf_dir)))


@query(
    "g20_truth_free_validation",
    SQL_PAIRS
    + ", long AS (SELECT 'corrected' AS model, y_pred FROM pairs UNION ALL SELECT 'identity', y_true FROM pairs) SELECT model, "
    + sql_round(
        [
            ("forward_scattering_fraction", _FWD),
            ("mean_cos_theta", "avg(y_pred)"),
            ("std_cos_theta", "stddev_pop(y_pred)"),
            ("fraction_in_bounds", "avg(CASE WHEN y_pred >= 0 AND y_pred <= 1 THEN 1.0 ELSE 0.0 END)"),
        ]
    )
    + " FROM long GROUP BY model",
)
def g20(spark, sf_dir):
    wide = pairs(spark, sf_dir).select(F.col("y_pred").alias("corrected"), F.col("y_true").alias("identity"))
    return rounded(M.validate_models(M.to_model_rows(wide, ["corrected", "identity"])))


@query(
    "g21_constraint_satisfaction",
    SQL_PAIRS
    + " SELECT "
    + sql_round(
        [
            ("bounds_violation_rate", "avg(CASE WHEN y_pred < 0 OR y_pred > 1 THEN 1.0 ELSE 0.0 END)"),
            ("mean_cos_theta_star", "avg(y_pred)"),
            ("prediction_std", "stddev_pop(y_pred)"),
            ("prediction_variance", "var_pop(y_pred)"),
            ("forward_scattering_fraction", "avg(CASE WHEN y_pred > 0.5 THEN 1.0 ELSE 0.0 END)"),
        ]
    )
    + " FROM pairs",
)
def g21(spark, sf_dir):
    return rounded(M.constraint_satisfaction(pairs(spark, sf_dir)))


_LOSS = {
    "mse_loss": "avg((y_pred - y_true) * (y_pred - y_true))",
    "bounds_penalty": "avg(greatest(-y_pred, 0.0)) + avg(greatest(y_pred - 1, 0.0))",
    "forward_preference": "avg(greatest(0.2 - y_pred, 0.0))",
    "variance_penalty": "greatest(0.01 - var_samp(y_pred), 0.0)",
}


@query(
    "g22_physics_loss",
    SQL_PAIRS
    + " SELECT "
    + sql_round(
        [
            *_LOSS.items(),
            (
                "total_loss",
                "{mse_loss} + 0.1 * ({bounds_penalty}) + 0.01 * {forward_preference} + 0.005 * {variance_penalty}".format(
                    **_LOSS
                ),
            ),
        ]
    )
    + " FROM pairs",
)
def g22(spark, sf_dir):
    return rounded(M.physics_loss(pairs(spark, sf_dir)))


@query(
    "g23_prediction_summary",
    SQL_PAIRS
    + " SELECT "
    + sql_round([("mean", "avg(y_pred)"), ("std", "stddev_pop(y_pred)"), ("min", "min(y_pred)"), ("max", "max(y_pred)")])
    + " FROM pairs",
)
def g23(spark, sf_dir):
    return rounded(M.prediction_summary(pairs(spark, sf_dir)))


@query(
    "g27_scatter_summary",
    SQL_PAIRS
    + " SELECT "
    + sql_round(
        [
            ("r_squared", "pow(corr(y_true, y_pred), 2)"),
            ("rmse", f"sqrt(avg({ERR}*{ERR}))"),
            ("mean_residual", "avg(y_pred - y_true)"),
        ]
    )
    + " FROM pairs",
)
def g27(spark, sf_dir):
    return rounded(M.scatter_summary(pairs(spark, sf_dir)))


def _panel_sql() -> str:
    e = {**dict(_FORWARD), **dict(_MOMENTS), **dict(_QUANTILE_ROWS)}
    rows = []

    def add(panel, item, a, b, source="pairs"):
        rows.append(
            f"SELECT '{panel}' AS panel, '{item}' AS item, round({a}, 6) + 0.0 AS truth, round({b}, 6) + 0.0 AS predicted, "
            f"NULL::VARCHAR AS status FROM {source}"
        )

    add("moments", "Mean", e["mean_true"], e["mean_pred"])
    add("moments", "Std", e["std_true"], e["std_pred"])
    add("moments", "Skewness", _skew("y_true"), _skew("y_pred"), "pm")
    add("moments", "Kurtosis", "kurtosis_pop(y_true)", "kurtosis_pop(y_pred)")
    for k in (70, 80, 90):
        add("forward", f">{k}%", e[f"forward_fraction_true_{k}"], e[f"forward_fraction_pred_{k}"])
    for q in M.QUANTILES:
        k = M.percent(q)
        add("quantiles", str(k), e[f"quantile_{k}_true"], e[f"quantile_{k}_pred"])
    scores = [
        ("Forward Difference (80%)", f"(SELECT {e['forward_difference_80']} FROM pairs)"),
        ("Mean Difference", f"(SELECT {e['mean_difference']} FROM pairs)"),
        ("KS Statistic", f"(SELECT {KS} FROM cdf)"),
        ("QCD Score", f"((SELECT {_SCORE} FROM pairs) + 0.5 * (SELECT {KS} FROM cdf))"),
    ]
    for item, value in scores:
        rows.append(
            f"SELECT 'scores', '{item}', NULL::DOUBLE, round({value}, 6), CASE WHEN {value} < 0.05 THEN 'green' "
            f"WHEN {value} < 0.1 THEN 'orange' ELSE 'red' END"
        )
    return SQL_CDF + _MU + " " + " UNION ALL ".join(rows)


@query("g28_validation_panels", _panel_sql())
def g28(spark, sf_dir):
    return rounded(M.validation_panels(M.evaluate_predictions(pairs(spark, sf_dir))))


# ---------------------------------------------------------------- extremes


@query(
    "a4_extreme_predictions",
    SQL_OBS
    + _SCORED
    + " (SELECT event_id, round(y_pred, 6) AS y_pred, 'high' AS side FROM scored ORDER BY scored.y_pred DESC, event_id DESC LIMIT 10)"
    " UNION ALL (SELECT event_id, round(y_pred, 6), 'low' FROM scored ORDER BY scored.y_pred, event_id LIMIT 10)",
)
def a4(spark, sf_dir):
    rows = I.extreme_rows(_scored(spark, sf_dir).select("event_id", "y_pred"), "y_pred", 10)
    return rounded(rows.select("event_id", "y_pred", "side"))


_EXTREME = ["mjj", "delta_y", "pt_balance", "eta_centrality"]


@query(
    "g29_extreme_profile",
    SQL_OBS
    + _SCORED
    + ", hi AS (SELECT * FROM scored ORDER BY y_pred DESC, event_id DESC LIMIT 10), "
    "lo AS (SELECT * FROM scored ORDER BY y_pred, event_id LIMIT 10) "
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, "
        + sql_round(
            [
                ("high_mean", f"(SELECT avg({f}) FROM hi)"),
                ("high_std", f"(SELECT stddev_pop({f}) FROM hi)"),
                ("low_mean", f"(SELECT avg({f}) FROM lo)"),
                ("low_std", f"(SELECT stddev_pop({f}) FROM lo)"),
                ("high_vs_overall", f"(SELECT avg({f}) FROM hi) - (SELECT avg({f}) FROM scored)"),
                ("low_vs_overall", f"(SELECT avg({f}) FROM lo) - (SELECT avg({f}) FROM scored)"),
            ],
            4,
        )
        for f in _EXTREME
    ),
)
def g29(spark, sf_dir):
    return rounded(I.extreme_profile(_scored(spark, sf_dir), "y_pred", _EXTREME, 10), 4)


# ---------------------------------------------------------------- X: splits


def _hash_sql(seed: int) -> str:
    a = f"(event_id % {PRIME})"
    b = f"(({a} * {MULTIPLIER} + {seed}) % {PRIME})"
    return f"(({b} * ({b} % {FOLD}) + {a}) % {PRIME})"


SPLIT_SQL = (
    f"CASE WHEN {_hash_sql(42)} < {int(0.2 * PRIME)} THEN 'test' "
    f"WHEN {_hash_sql(43)} < {int(0.2 * PRIME)} THEN 'validation' ELSE 'train' END"
)


@query("x1_train_validation_test_split", SQL_OBS + f" SELECT event_id, {SPLIT_SQL} AS split FROM obs")
def x1(spark, sf_dir):
    return add_split(observed(spark, sf_dir).select("event_id"))


@query(
    "x2_detector_training_rows",
    SQL_OBS
    + f" SELECT event_id, round(mjj, 4) AS mjj FROM obs WHERE {SQL_TRAINING}",
)
def x2(spark, sf_dir):
    return rounded(training_share(observed(spark, sf_dir).select("event_id", "mjj")), 4)


# ---------------------------------------------------------------- M: scaling

SCALED = ["mjj", "delta_y", "delta_phi", "pt_balance", "average_pt"]
_CENTER = {
    "robust": ("quantile_cont({f}, 0.5)", "quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25)"),
    "standard": ("avg({f})", "stddev_pop({f})"),
    "minmax": ("min({f})", "max({f}) - min({f})"),
}


def _fit_sql(method: str, source: str) -> str:
    c, s = _CENTER[method]
    parts = ", ".join(f"{c.format(f=f)} AS c_{f}, {s.format(f=f)} AS s_{f}" for f in SCALED)
    return f", fit AS (SELECT {parts} FROM {source})"


def _scaled_sql(method: str) -> str:
    columns = sql_round([(f, f"({f} - c_{f}) / s_{f}") for f in SCALED])
    return SQL_OBS + _fit_sql(method, "obs") + f" SELECT event_id, {columns} FROM obs, fit"


def _scaling_query(qid: str, method: str):
    @query(f"{qid}_{method}_scale", _scaled_sql(method))
    def run(spark, sf_dir):
        rows = observed(spark, sf_dir).select("event_id", *SCALED)
        return rounded(FeatureScaler(method).fit_transform(rows, SCALED))


for _qid, _method in (("m1", "robust"), ("m2", "standard"), ("m3", "minmax")):
    _scaling_query(_qid, _method)


@query(
    "m4_apply_fitted_scaler",
    SQL_OBS
    + f", parts AS (SELECT *, {SPLIT_SQL} AS split FROM obs), training AS (SELECT * FROM parts WHERE split = 'train')"
    + _fit_sql("standard", "training")
    + f" SELECT event_id, {sql_round([(f, f'({f} - c_{f}) / s_{f}') for f in SCALED])} FROM parts, fit WHERE split <> 'train'",
)
def m4(spark, sf_dir):
    rows = add_split(observed(spark, sf_dir).select("event_id", *SCALED))
    scaler = FeatureScaler("standard")
    scaler.fit(rows.where(F.col("split") == "train"), SCALED)
    return rounded(scaler.transform(rows.where(F.col("split") != "train")).drop("split"))


@query("m5_inverse_transform", SQL_OBS + f" SELECT event_id, {sql_round(SCALED)} FROM obs")
def m5(spark, sf_dir):
    rows = observed(spark, sf_dir).select("event_id", *SCALED)
    scaler = FeatureScaler("minmax")
    return rounded(scaler.inverse_transform(scaler.fit_transform(rows, SCALED)))


# ---------------------------------------------------------------- M: feature selection

SCORED_FEATURES = ["mjj", "delta_phi", "pt_balance", "dijet_pt", "eta_centrality", "leading_jet_m", "n_jets"]
_F_ROWS = ", f_rows AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, pow(corr({f}, cos_theta_star), 2) AS r2, count(*) AS n FROM obs" for f in SCORED_FEATURES
) + "), f_scores AS (SELECT feature, r2 * (n - 2) / (1 - r2) AS score FROM f_rows)"


@query("m7_f_statistic_k_best", SQL_OBS + _F_ROWS + " SELECT feature, round(score, 4) AS score FROM f_scores ORDER BY f_scores.score DESC LIMIT 4")
def m7(spark, sf_dir):
    selector = FS.FeatureSelector("f_regression", k=4).fit(observed(spark, sf_dir), SCORED_FEATURES, "cos_theta_star")
    best = selector.ranking().where(F.col("feature").isin(selector.selected))
    return rounded(best, 4)


@query("m10_feature_ranking", SQL_OBS + _F_ROWS + " SELECT feature, round(score, 4) AS score, rank() OVER (ORDER BY f_scores.score DESC) AS pos FROM f_scores")
def m10(spark, sf_dir):
    selector = FS.FeatureSelector("f_regression", k=4).fit(observed(spark, sf_dir), SCORED_FEATURES, "cos_theta_star")
    ranked = selector.ranking()
    # Seven rows: the position is the number of better scores plus one.
    better = F.size(F.filter(F.lit([float(r["score"]) for r in ranked.collect()]), lambda s: s > F.col("score")))
    return rounded(ranked.withColumn("pos", (better + 1).cast("bigint")), 4)


def _mi_sql() -> str:
    grid = [i / FS.MI_BINS for i in range(1, FS.MI_BINS)]
    names = [*SCORED_FEATURES, "cos_theta_star"]
    edges = ", ".join(f"quantile_cont({c}, {grid}) AS q_{c}" for c in names)
    buckets = ", ".join(f"len(list_filter(q_{c}, lambda e: e <= {c})) AS b_{c}" for c in names)
    cells = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, b_{f} AS bx, b_cos_theta_star AS by_, count(*) AS n FROM bucketed GROUP BY 1, 2, 3"
        for f in SCORED_FEATURES
    )
    return (
        SQL_OBS
        + f", steady AS (SELECT {sql_round(names, 9)} FROM obs), edges AS (SELECT {edges} FROM steady), "
        f"bucketed AS (SELECT {buckets} FROM steady, edges), cells AS ({cells}), "
        "marg AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bx) AS nx, "
        "sum(n) OVER (PARTITION BY feature, by_) AS ny FROM cells), "
        "mi AS (SELECT feature, sum(n / t * ln(n * t / (nx * ny))) AS score FROM marg GROUP BY feature)"
    )


@query("m8_mutual_information", _mi_sql() + " SELECT feature, round(score, 6) AS score FROM mi")
def m8(spark, sf_dir):
    rows = steady(observed(spark, sf_dir).select(*SCORED_FEATURES, "cos_theta_star"))
    return rounded(FS.mutual_information_scores(rows, SCORED_FEATURES, "cos_theta_star"))


@query(
    "m11_correlations_with_mutual_information",
    _mi_sql()
    + ", c AS ("
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, corr({f}, cos_theta_star) AS r FROM obs" for f in SCORED_FEATURES)
    + ") SELECT feature, round(r, 6) AS pearson_correlation, round(abs(r), 6) AS abs_correlation, "
    "round(score, 6) AS mutual_information FROM c JOIN mi USING (feature)",
)
def m11(spark, sf_dir):
    rows = steady(observed(spark, sf_dir).select(*SCORED_FEATURES, "cos_theta_star"))
    scores = FS.mutual_information_scores(rows, SCORED_FEATURES, "cos_theta_star")
    return rounded(C.feature_target_correlations(rows, "cos_theta_star", SCORED_FEATURES, scores))


@query("m9_tree_importance")
def m9(spark, sf_dir):
    return FS.tree_importance_scores(
        observed(spark, sf_dir), SCORED_FEATURES, "cos_theta_star"
    )
