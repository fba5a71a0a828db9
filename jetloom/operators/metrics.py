"""Truth-versus-prediction statistics over (y_true, y_pred) tables.

All moment families come out of one aggregation; the distribution families come from the
CDF and rank tables of :mod:`jetloom.operators.distribution`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jetloom.functions.kinematics import nan_low, quality_status
from jetloom.functions.moments import correlation, deviation, variance
from jetloom.functions.pvalues import correlation_pvalue
from jetloom.operators import distribution as D
from jetloom.session import stage

# Fixed values of the metric battery.
FORWARD_THRESHOLDS = (0.7, 0.8, 0.9)
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
EXPECTED_FORWARD_FRACTION = 0.6
EXPECTED_MEAN = 0.75
HIGH_MASS_GEV = 500.0
MIN_HIGH_MASS_EVENTS = 100
SLOPE_RANGE = (-5.0, -4.0)


def _truth() -> Column:
    return F.col("y_true")


def _pred() -> Column:
    return F.col("y_pred")


def fraction(condition: Column) -> Column:
    """Share of rows meeting a condition; NaN rows do not meet it but count."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def _exceeds(value: Column, threshold: float) -> Column:
    return nan_low(value) > F.lit(threshold)


def _in_bounds(value: Column) -> Column:
    return (value >= 0.0) & (value <= 1.0)


def percent(share: float) -> int:
    """Whole-percent suffix of a threshold or quantile key."""
    return round(share * 100)


def r2(truth: Column, pred: Column) -> Column:
    """1 - SSE/SST; for constant truth 1 when exact and 0 otherwise."""
    sse = F.sum((truth - pred) * (truth - pred))
    sst = F.count(truth) * variance(truth)
    return F.when(sst > 0, 1 - F.try_divide(sse, sst)).otherwise(
        F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    )


def error_aggregates() -> dict[str, Column]:
    """r2, mse, rmse, mae, mape."""
    err = _truth() - _pred()
    return {
        "r2_score": r2(_truth(), _pred()),
        "mse": F.avg(err * err),
        "rmse": F.sqrt(F.avg(err * err)),
        "mae": F.avg(F.abs(err)),
        "mape": F.avg(F.abs(F.try_divide(err, _truth() + F.lit(1e-8)))) * 100.0,
    }


def forward_aggregates() -> dict[str, Column]:
    """Forward fractions of truth and prediction and their absolute difference."""
    out: dict[str, Column] = {}
    for threshold in FORWARD_THRESHOLDS:
        key = percent(threshold)
        true, pred = fraction(_exceeds(_truth(), threshold)), fraction(_exceeds(_pred(), threshold))
        out[f"forward_fraction_true_{key}"] = true
        out[f"forward_fraction_pred_{key}"] = pred
        out[f"forward_difference_{key}"] = F.abs(true - pred)
    return out


def moment_aggregates() -> dict[str, Column]:
    """Means, population deviations, their comparison, skewness and excess kurtosis."""
    return {
        "mean_true": F.avg(_truth()),
        "mean_pred": F.avg(_pred()),
        "mean_difference": F.abs(F.avg(_truth()) - F.avg(_pred())),
        "std_true": deviation(_truth()),
        "std_pred": deviation(_pred()),
        "std_ratio": F.try_divide(deviation(_pred()), deviation(_truth())),
        "skewness_true": F.skewness(_truth()),
        "skewness_pred": F.skewness(_pred()),
        "kurtosis_true": F.kurtosis(_truth()),
        "kurtosis_pred": F.kurtosis(_pred()),
    }


def bounds_aggregates() -> dict[str, Column]:
    """Share inside [0, 1] and the summed overshoot of the predictions."""
    overshoot = F.greatest(-_pred(), F.lit(0.0)) + F.greatest(_pred() - 1.0, F.lit(0.0))
    return {
        "fraction_in_bounds_true": fraction(_in_bounds(_truth())),
        "fraction_in_bounds_pred": fraction(_in_bounds(_pred())),
        "out_of_bounds_penalty": F.sum(overshoot),
    }


def _named(aggregates: dict[str, Column]) -> list[Column]:
    return [column.alias(name) for name, column in aggregates.items()]


def moment_metrics(pairs: DataFrame) -> DataFrame:
    """Every single-pass metric in one row; unused ones are pruned by the optimizer."""
    families = (error_aggregates, forward_aggregates, moment_aggregates, bounds_aggregates)
    columns = [c for family in families for c in _named(family())]
    return pairs.agg(*columns)


def pearson(pairs: DataFrame) -> DataFrame:
    """Pearson correlation and p-value, one row."""
    return pairs.agg(correlation("y_true", "y_pred").alias("pearson_correlation"), F.count("y_true").alias("_n")).select(
        "pearson_correlation",
        correlation_pvalue(F.col("pearson_correlation"), F.col("_n")).alias("pearson_pvalue"),
    )


def quantile_metrics(pairs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Truth and prediction quantiles side by side, one row per probability."""
    return _side_by_side(stage(D.joint_table(pairs, "y_true", "y_pred", ranges)), QUANTILES)


def quantile_quantile(pairs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Q-Q table on the 99 percentiles."""
    grid = [i / 100 for i in range(1, 100)]
    return _side_by_side(stage(D.joint_table(pairs, "y_true", "y_pred", ranges)), grid)


def _side_by_side(table: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    true = D.quantiles_of(table, probabilities, "n_a").select("q", F.col("value").alias("q_true"))
    pred = D.quantiles_of(table, probabilities, "n_b").select("q", F.col("value").alias("q_pred"))
    return true.join(pred, "q").withColumn("q_difference", F.abs(F.col("q_true") - F.col("q_pred")))


def _long(row: DataFrame) -> DataFrame:
    """A one-row table of metrics as (metric, value) rows."""
    doubles = row.select(*[F.col(c).cast("double").alias(c) for c in row.columns])
    return doubles.unpivot([], doubles.columns, "metric", "value")


def _pick(metric: str) -> Column:
    return F.max(F.when(F.col("metric") == metric, F.col("value")))


def evaluate_predictions(pairs: DataFrame, ranges: int | None = None) -> DataFrame:
    """The whole battery as (metric, value) rows.

    One pass for all moments; one cumulated table for KS, Wasserstein, quantiles and
    ranks; the two rank lookups. Only one-row results are ever combined.
    """
    pairs = stage(pairs.select("y_true", "y_pred"))
    collapsed = stage(D.distinct_pairs(pairs, "y_true", "y_pred"))
    table = stage(D.joint_table(collapsed, "y_true", "y_pred", ranges, "times"))
    suffix = F.concat(F.lit("quantile_"), F.round(F.col("q") * 100).cast("int").cast("string"))
    quantile_rows = _side_by_side(table, QUANTILES).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.concat(suffix, F.lit(f"_{name}")).alias("metric"), F.col(f"q_{name}").alias("value")
                    )
                    for name in ("true", "pred", "difference")
                ]
            )
        )
    )
    parts = [
        _long(moment_metrics(pairs)),
        _long(D.two_sample_distances(D.cdf_of(table))),
        quantile_rows,
        _long(pearson(pairs)),
        _long(D.spearman_of(collapsed, table, "y_true", "y_pred")),
    ]
    battery = parts[0]
    for part in parts[1:]:
        battery = battery.unionByName(part)
    battery = stage(battery)
    return battery.unionByName(_long(consistency_score(battery)))


def consistency_score(battery: DataFrame) -> DataFrame:
    """Weighted disagreement: forward difference, mean difference and KS statistic."""
    return battery.agg(
        (
            _pick("forward_difference_80") * 2.0
            + _pick("mean_difference")
            + _pick("kolmogorov_smirnov_statistic") * 0.5
        ).alias("qcd_consistency_score")
    )


def validation_panels(battery: DataFrame) -> DataFrame:
    """(panel, item, truth, predicted, status) rows for a validation report."""
    moments = [("Mean", "mean"), ("Std", "std"), ("Skewness", "skewness"), ("Kurtosis", "kurtosis")]
    forward = [(f">{percent(t)}%", percent(t)) for t in FORWARD_THRESHOLDS]
    scores = [
        ("Forward Difference (80%)", "forward_difference_80"),
        ("Mean Difference", "mean_difference"),
        ("KS Statistic", "kolmogorov_smirnov_statistic"),
        ("QCD Score", "qcd_consistency_score"),
    ]
    entries = [("moments", label, f"{key}_true", f"{key}_pred") for label, key in moments]
    entries += [
        ("forward", label, f"forward_fraction_true_{key}", f"forward_fraction_pred_{key}")
        for label, key in forward
    ]
    entries += [
        ("quantiles", str(percent(q)), f"quantile_{percent(q)}_true", f"quantile_{percent(q)}_pred")
        for q in QUANTILES
    ]
    needed = sorted({m for *_, a, b in entries for m in (a, b)} | {m for _, m in scores})
    wide = battery.agg(*[_pick(m).alias(m) for m in needed])
    nothing, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")

    def row(panel: str, item: str, truth: Column, predicted: Column, status: Column) -> Column:
        return F.struct(
            F.lit(panel).alias("panel"),
            F.lit(item).alias("item"),
            truth.alias("truth"),
            predicted.alias("predicted"),
            status.alias("status"),
        )

    rows = [row(panel, item, F.col(a), F.col(b), no_text) for panel, item, a, b in entries]
    rows += [row("scores", label, nothing, F.col(m), quality_status(m)) for label, m in scores]
    return wide.select(F.inline(F.array(*rows)))


# ---------------------------------------------------------------- single-series checks


def validate_angular(pred: DataFrame, column: str = "y_pred", truth: str | None = None) -> DataFrame:
    """Forward fraction and mean against expectation; KS columns when truth is given."""
    c = F.col(column)
    forward, mean = fraction(_exceeds(c, 0.8)), F.avg(c)
    forward_dev = F.abs(forward - EXPECTED_FORWARD_FRACTION)
    mean_dev = F.abs(mean - EXPECTED_MEAN)
    row = pred.agg(
        forward.alias("forward_scattering_fraction"),
        forward_dev.alias("forward_scattering_deviation"),
        mean.alias("mean_cos_theta_star"),
        mean_dev.alias("mean_deviation"),
        (forward_dev * 2.0 + mean_dev).alias("qcd_consistency_score"),
    )
    if truth is None:
        return row
    distances = D.two_sample_distances(D.joint_cdf(pred, truth, column))
    return row.withColumns(
        {
            "ks_statistic": distances.select("kolmogorov_smirnov_statistic").scalar(),
            "ks_pvalue": distances.select("kolmogorov_smirnov_pvalue").scalar(),
        }
    )


def validate_mass_spectrum(df: DataFrame, mjj: str = "mjj", weight: Column | None = None) -> DataFrame:
    """Power-law fit of the high-mass spectrum, one row.

    With too few high-mass events the fit columns are null and ``insufficient`` is true.
    """
    w = F.lit(1.0) if weight is None else weight
    high = df.where(_exceeds(F.col(mjj), HIGH_MASS_GEV)).select(
        F.ln(mjj).alias("_x"), F.ln(w + F.lit(1e-10)).alias("_y")
    )
    fit = high.agg(
        F.count(F.lit(1)).alias("n_high_mass"),
        F.regr_slope("_y", "_x").alias("_slope"),
        correlation("_y", "_x").alias("_r"),
        variance("_y").alias("_var_y"),
    )
    enough = F.col("n_high_mass") > MIN_HIGH_MASS_EVENTS
    low, high_edge = SLOPE_RANGE
    return fit.select(
        "n_high_mass",
        (~enough).alias("insufficient_high_mass_events"),
        F.when(enough, F.col("_slope")).alias("power_law_slope"),
        F.when(enough, F.when(F.col("_var_y") > 0, F.col("_r") * F.col("_r")).otherwise(0.0)).alias(
            "power_law_r_squared"
        ),
        F.when(enough, (F.col("_slope") > low) & (F.col("_slope") < high_edge)).alias("slope_consistent"),
    )


def validate_models(long: DataFrame) -> DataFrame:
    """Truth-free checks per model over (model, y_pred) rows."""
    return long.groupBy("model").agg(
        fraction(_exceeds(_pred(), 0.8)).alias("forward_scattering_fraction"),
        F.avg(_pred()).alias("mean_cos_theta"),
        deviation(_pred()).alias("std_cos_theta"),
        fraction(_in_bounds(_pred())).alias("fraction_in_bounds"),
    )


def constraint_satisfaction(pred: DataFrame) -> DataFrame:
    """How far predictions respect the physical range, one row."""
    return pred.agg(
        fraction((_pred() < 0.0) | _exceeds(_pred(), 1.0)).alias("bounds_violation_rate"),
        F.avg(_pred()).alias("mean_cos_theta_star"),
        deviation(_pred()).alias("prediction_std"),
        variance(_pred()).alias("prediction_variance"),
        fraction(_exceeds(_pred(), 0.5)).alias("forward_scattering_fraction"),
    )


def physics_loss(pairs: DataFrame, physics_weight: float = 0.1) -> DataFrame:
    """Physics-informed loss of a prediction table and its terms, one row."""
    zero = F.lit(0.0)
    row = pairs.agg(
        F.avg((_pred() - _truth()) * (_pred() - _truth())).alias("mse_loss"),
        (F.avg(F.greatest(-_pred(), zero)) + F.avg(F.greatest(_pred() - 1.0, zero))).alias("bounds_penalty"),
        F.avg(F.greatest(0.2 - _pred(), zero)).alias("forward_preference"),
        F.greatest(0.01 - F.var_samp(_pred()), zero).alias("variance_penalty"),
    )
    total = (
        F.col("mse_loss")
        + physics_weight * F.col("bounds_penalty")
        + physics_weight * 0.1 * F.col("forward_preference")
        + physics_weight * 0.05 * F.col("variance_penalty")
    )
    return row.withColumn("total_loss", total)


def prediction_summary(pred: DataFrame) -> DataFrame:
    """Mean, population deviation, minimum and maximum of the predictions."""
    return pred.agg(
        F.avg(_pred()).alias("mean"), deviation(_pred()).alias("std"), F.min(_pred()).alias("min"), F.max(_pred()).alias("max")
    )


def scatter_summary(pairs: DataFrame) -> DataFrame:
    """Squared correlation, rmse and mean residual of a prediction scatter."""
    return pairs.agg(
        F.pow(correlation("y_true", "y_pred"), F.lit(2.0)).alias("r_squared"),
        F.sqrt(F.avg((_truth() - _pred()) * (_truth() - _pred()))).alias("rmse"),
        F.avg(_pred() - _truth()).alias("mean_residual"),
    )


def threshold_masks(df: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """Number of rows meeting each named condition, in one pass."""
    return df.agg(*[F.count_if(condition).alias(name) for name, condition in masks.items()])


def to_model_rows(df: DataFrame, prediction_columns: Sequence[str]) -> DataFrame:
    """Side-by-side prediction columns as (model, y_pred) rows."""
    return df.select(*prediction_columns).unpivot([], list(prediction_columns), "model", "y_pred")
