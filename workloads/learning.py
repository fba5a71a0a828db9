"""Models, anomaly detection and model interpretation."""

from __future__ import annotations

from pyspark.sql import functions as F

from jetloom.operators import anomaly as AN
from jetloom.operators import models as ML
from jetloom.operators.features import TARGET_PROXIES, add_features, feature_columns
from jetloom.operators.interpret import prediction_sensitivity
from jetloom.operators.scaling import FeatureScaler
from jetloom.operators.splits import add_split, training_share
from jetloom.plans import flows
from jetloom.session import stage, stage_path
from workloads.base import SQL_OBS, SQL_PAIRS, SQL_TRAINING, nested_events, observed, pairs, query, rounded, sql_round

TARGET = "cos_theta_star"
FEATURES = ["mjj", "delta_phi", "pt_balance", "leading_jet_pt", "subleading_jet_pt", "eta_centrality", "n_jets"]


def _rows(spark, sf_dir):
    return stage(observed(spark, sf_dir).select("event_id", TARGET, *FEATURES))


def _boosted(rows):
    fitting = add_split(rows).where(F.col("split") != "test")
    fitting = fitting.withColumn("_validation", F.col("split") == "validation")
    return ML.train_boosted_trees(fitting, FEATURES, TARGET, "_validation")


@query("l1_boosted_trees")
def l1(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return ML.score(_boosted(rows), rows).select("event_id", "predicted_cos_theta_star")


@query("l2_validation_metrics")
def l2(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    held_out = add_split(rows).where(F.col("split") == "validation")
    return ML.regression_metrics(ML.score(_boosted(rows), held_out, "y_pred"), TARGET, "y_pred")


@query("l3_score_table")
def l3(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    model = ML.train_bounded(add_split(rows).where(F.col("split") == "train"), FEATURES, TARGET)
    return ML.score(model, rows)


@query("l4_split_importance")
def l4(spark, sf_dir):
    return ML.split_counts(_boosted(_rows(spark, sf_dir)), FEATURES)


@query("l5_bounded_regressor")
def l5(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    model = ML.train_bounded(add_split(rows).where(F.col("split") == "train"), FEATURES, TARGET)
    scored = ML.score(model, rows, "y_pred")
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.min("y_pred").alias("lowest"),
        F.max("y_pred").alias("highest"),
        F.avg(F.abs(F.col("y_pred") - F.col(TARGET))).alias("mae"),
    )


@query("l6_training_flow")
def l6(spark, sf_dir):
    table = add_features(observed(spark, sf_dir))
    return flows.train(table).evaluation


@query("l7_inference_flow")
def l7(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    scaler = FeatureScaler("robust").fit(rows, FEATURES)
    model = ML.train_bounded(scaler.transform(rows), FEATURES, TARGET)
    path = stage_path(spark, "bundle")
    detector = AN.AnomalyDetector("elliptic_envelope")
    detector.fit(scaler.transform(rows), FEATURES)
    flows.save_bundle(spark, flows.InferenceBundle({"bounded": model}, FEATURES, scaler, detector), path)
    bundle = flows.load_bundle(spark, path)
    source = stage_path(spark, "events")
    nested_events(spark, sf_dir).write.parquet(source)
    scored = flows.infer(spark, source, bundle)
    return scored.select("event_id", "bounded", "anomaly_detector_scores", "anomaly_detector_predictions")


@query("l8_models_side_by_side")
def l8(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    training = add_split(rows).where(F.col("split") == "train")
    models = {
        "bounded": ML.train_bounded(training, FEATURES, TARGET),
        "few_features": ML.train_bounded(training, FEATURES[:3], TARGET),
        "unusable": ML.train_bounded(training.withColumn("absent", F.col("mjj")), ["absent"], TARGET),
    }
    scored, used = ML.score_all(models, rows)
    return scored.select("event_id", *used)


@query("s18_save_and_load_model")
def s18(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    path = stage_path(spark, "model")
    ML.save_model(ML.train_bounded(rows, FEATURES, TARGET), path, {"target": TARGET})
    model, metadata = ML.load_model(path)
    return ML.score(model, rows).select("event_id", "predicted_cos_theta_star", F.lit(metadata["target"]).alias("target"))


@query("i1_prediction_sensitivity")
def i1(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    model = ML.train_bounded(add_split(rows).where(F.col("split") == "train"), FEATURES, TARGET)
    return prediction_sensitivity(model, rows, FEATURES)


# ---------------------------------------------------------------- N: anomalies


def _detected(spark, sf_dir, method):
    rows = _rows(spark, sf_dir)
    detector = AN.AnomalyDetector(method)
    detector.fit(training_share(rows), FEATURES)
    return detector.detect(rows).select("event_id", "anomaly_score", "is_anomaly"), detector, rows


@query("n1_isolation_forest")
def n1(spark, sf_dir):
    return _detected(spark, sf_dir, "isolation_forest")[0]


@query("n2_elliptic_envelope")
def n2(spark, sf_dir):
    return _detected(spark, sf_dir, "elliptic_envelope")[0]


@query("n3_reconstruction_error")
def n3(spark, sf_dir):
    # Code size min(8, d) must stay below d for an error to exist: use the full feature set.
    table = add_features(observed(spark, sf_dir))
    names = feature_columns(table, TARGET_PROXIES)
    rows = stage(table.select("event_id", *names))
    detector = AN.AnomalyDetector("reconstruction")
    detector.fit(training_share(rows), names)
    return detector.detect(rows).select("event_id", "anomaly_score", "is_anomaly")


@query("n4_reconstruction_quality")
def n4(spark, sf_dir):
    table = add_features(observed(spark, sf_dir))
    names = feature_columns(table, TARGET_PROXIES)
    rows = stage(table.select("event_id", *names))
    detector = AN.AnomalyDetector("reconstruction")
    detector.fit(training_share(rows), names)
    quality = detector.reconstruction_quality(rows)
    return quality.select("event_id", "total_reconstruction_error", "max_feature_error", "mean_absolute_error")


@query("n5_standardised_inputs")
def n5(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    scaler = FeatureScaler("standard")
    scaler.fit(training_share(rows), FEATURES)
    return scaler.transform(rows).agg(*[F.avg(f).alias(f) for f in FEATURES])


_FLAGS = (
    "CASE WHEN y_true > 0.7 THEN 1 ELSE 0 END + CASE WHEN y_pred > 0.7 THEN 1 ELSE 0 END"
    " + CASE WHEN y_pred > 0.9 THEN 1 ELSE 0 END"
)


def _votes_sql(condition: str) -> str:
    return (
        SQL_PAIRS
        + f" SELECT event_id, round((y_true + y_pred + y_pred) / 3.0, 9) AS ensemble_score, ({_FLAGS}) {condition} AS ensemble_anomaly FROM pairs"
    )


def _vote_query(voting: str, condition: str):
    @query(f"n6_ensemble_{voting}", _votes_sql(condition))
    def run(spark, sf_dir):
        rows = pairs(spark, sf_dir).select(
            "event_id",
            F.col("y_true").alias("s1"),
            F.col("y_pred").alias("s2"),
            F.col("y_pred").alias("s3"),
            (F.col("y_true") > 0.7).alias("f1"),
            (F.col("y_pred") > 0.7).alias("f2"),
            (F.col("y_pred") > 0.9).alias("f3"),
        )
        voted = AN.combine_votes(rows, ["s1", "s2", "s3"], ["f1", "f2", "f3"], voting)
        return rounded(voted.select("event_id", "ensemble_score", "ensemble_anomaly"), 9)


for _voting, _condition in (("majority", "> 1.5"), ("unanimous", "= 3"), ("any", "> 0")):
    _vote_query(_voting, _condition)


@query("n6_ensemble_detector")
def n6(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    ensemble = AN.EnsembleAnomalyDetector(("elliptic_envelope", "isolation_forest"))
    ensemble.fit(training_share(rows), FEATURES)
    return ensemble.detect(rows).drop(TARGET, *FEATURES)


def _both(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    training = stage(training_share(rows))
    detectors = [AN.AnomalyDetector(method) for method in ("isolation_forest", "elliptic_envelope")]
    for detector in detectors:
        detector.fit(training, FEATURES)
    return AN.detect_both(*detectors, rows)


@query("n7_compare_detectors")
def n7(spark, sf_dir):
    return AN.anomaly_rate(_both(spark, sf_dir), "both_anomaly")


@query("j1_join_detector_outputs")
def j1(spark, sf_dir):
    return _both(spark, sf_dir)


@query("g30_anomaly_rate")
def g30(spark, sf_dir):
    return AN.anomaly_rate(_detected(spark, sf_dir, "elliptic_envelope")[0])


# ---------------------------------------------------------------- SQL-checkable parts


@query(
    "l2_regression_metrics",
    SQL_PAIRS
    + " SELECT "
    + sql_round(
        [
            ("val_mse", "avg((y_true - y_pred) * (y_true - y_pred))"),
            ("val_mae", "avg(abs(y_true - y_pred))"),
            ("val_r2", "1 - sum((y_true - y_pred) * (y_true - y_pred)) / (count(*) * var_pop(y_true))"),
            ("val_rmse", "sqrt(avg((y_true - y_pred) * (y_true - y_pred)))"),
        ]
    )
    + " FROM pairs",
)
def l2_pairs(spark, sf_dir):
    return rounded(ML.regression_metrics(pairs(spark, sf_dir), "y_true", "y_pred"))


@query(
    "n5_standardised_rows",
    SQL_OBS
    + f", training AS (SELECT * FROM obs WHERE {SQL_TRAINING}), fit AS (SELECT "
    + ", ".join(f"avg({f}) AS c_{f}, stddev_pop({f}) AS s_{f}" for f in FEATURES)
    + " FROM training) SELECT event_id, "
    + sql_round([(f, f"({f} - c_{f}) / s_{f}") for f in FEATURES])
    + " FROM obs, fit",
)
def n5_rows(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    scaler = FeatureScaler("standard")
    scaler.fit(training_share(rows), FEATURES)
    return rounded(scaler.transform(rows).select("event_id", *FEATURES))


def _score_tables(spark, sf_dir):
    """Two detectors' score tables with stand-in scores, keyed by event id."""
    scored = pairs(spark, sf_dir)

    def output(score, threshold):
        return scored.select(
            "event_id", F.col(score).alias("anomaly_score"), (F.col(score) > threshold).alias("is_anomaly")
        )

    return output("y_pred", 0.9), output("y_true", 0.85)


@query(
    "j1_join_score_tables",
    SQL_PAIRS
    + " SELECT event_id, round(y_pred, 9) AS iso_forest_score, y_pred > 0.9 AS iso_forest_anomaly, "
    "round(y_true, 9) AS reconstruction_error, y_true > 0.85 AS reconstruction_anomaly, "
    "y_pred > 0.9 AND y_true > 0.85 AS both_anomaly FROM pairs",
)
def j1_tables(spark, sf_dir):
    return rounded(AN.compare_detectors(*_score_tables(spark, sf_dir)), 9)


@query(
    "g30_rate_of_score_table",
    SQL_PAIRS
    + " SELECT count(*) FILTER (WHERE y_pred > 0.9) AS n_anomalies, count(*) AS n_events, "
    "round(avg(CASE WHEN y_pred > 0.9 THEN 1.0 ELSE 0.0 END), 6) AS anomaly_rate FROM pairs",
)
def g30_table(spark, sf_dir):
    return rounded(AN.anomaly_rate(_score_tables(spark, sf_dir)[0]))


@query(
    "n7_rate_of_common_anomalies",
    SQL_PAIRS
    + " SELECT count(*) FILTER (WHERE y_pred > 0.9 AND y_true > 0.85) AS n_anomalies, count(*) AS n_events, "
    "round(avg(CASE WHEN y_pred > 0.9 AND y_true > 0.85 THEN 1.0 ELSE 0.0 END), 6) AS anomaly_rate FROM pairs",
)
def n7_tables(spark, sf_dir):
    return rounded(AN.anomaly_rate(AN.compare_detectors(*_score_tables(spark, sf_dir)), "both_anomaly"))
