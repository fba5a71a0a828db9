"""Learners on labels they must hit exactly, so that SQL can check them.

The bounded regressor learns a logistic function of one feature, the trees learn a step function of it, and detectors
meet planted outliers or rows that lie in a plane. All rows come from the driver's tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from jetloom.operators import anomaly as AN
from jetloom.operators import models as ML
from jetloom.operators.feature_selection import tree_importance_scores
from jetloom.operators.features import add_features
from jetloom.operators.interpret import prediction_sensitivity
from jetloom.operators.physics_fit import PhysicsFitConfig, train_on_physics_loss
from jetloom.operators.scaling import FeatureScaler
from jetloom.operators.splits import add_split, training_share
from jetloom.plans import flows
from jetloom.session import stage, stage_path
from workloads.base import SQL_NESTED, SQL_OBS, nested_events, observed, query, rounded, sql_observed

FEATURES = ["mjj", "delta_phi", "pt_balance", "leading_jet_pt", "subleading_jet_pt", "eta_centrality", "n_jets"]
LABEL = "label"
DIGITS = 4
# An exact binary fraction per jet count; counts from six on, which are rare, share one.
STEPS = "least(n_jets, 6) / 8.0D"
# Every feature is looked at in every node, so that the one that decides is never left out.
ALL_FEATURES = ML.BoostedTreesConfig(feature_share=1.0)
# Every so many ids are planted as outliers.
PLANTED = 997


def _sql_logistic(jets: str = "n_jets") -> str:
    return f"1.0 / (1.0 + exp(1.5 - 0.4 * ({jets})))"


def _rows(spark, sf_dir, label):
    return stage(observed(spark, sf_dir).select("event_id", *FEATURES).withColumn(LABEL, F.expr(label)))


def _logistic(spark, sf_dir):
    """Rows and a bounded regressor fitted on their training split."""
    rows = _rows(spark, sf_dir, _sql_logistic())
    return rows, ML.train_bounded(add_split(rows).where(F.col("split") == "train"), FEATURES, LABEL)


def _steps(spark, sf_dir):
    """Rows whose label is a step function of the jet count, and trees with early stopping."""
    rows = _rows(spark, sf_dir, STEPS)
    fitting = add_split(rows).where(F.col("split") != "test").withColumn("_validation", F.col("split") == "validation")
    return rows, ML.train_boosted_trees(fitting, FEATURES, LABEL, "_validation", ALL_FEATURES)


@query("l1_boosted_trees_on_steps", f"{SQL_OBS} SELECT event_id, least(n_jets, 6) / 8.0::DOUBLE AS predicted FROM obs")
def l1(spark, sf_dir):
    rows, model = _steps(spark, sf_dir)
    return rounded(ML.score(model, rows, "predicted").select("event_id", "predicted"))


@query("l2_validation_metrics_on_steps", "SELECT 0.0::DOUBLE AS val_mse, 0.0::DOUBLE AS val_mae, 1.0::DOUBLE AS val_r2, 0.0::DOUBLE AS val_rmse")
def l2(spark, sf_dir):
    rows, model = _steps(spark, sf_dir)
    held_out = add_split(rows).where(F.col("split") == "validation")
    return rounded(ML.regression_metrics(ML.score(model, held_out, "y_pred"), LABEL, "y_pred"))


@query("l3_score_known_logistic", f"{SQL_OBS} SELECT event_id, round({_sql_logistic()}, {DIGITS}) AS predicted FROM obs")
def l3(spark, sf_dir):
    rows, model = _logistic(spark, sf_dir)
    return rounded(ML.score(model, rows, "predicted").select("event_id", "predicted"), DIGITS)


_OTHERS = ", ".join(f"('{f}')" for f in FEATURES if f != "n_jets")


@query(
    "l4_split_importance_on_steps",
    f"{SQL_OBS} SELECT 'n_jets' AS feature, count(DISTINCT least(n_jets, 6)) - 1 AS importance FROM obs UNION ALL SELECT f, 0 FROM (VALUES {_OTHERS}) AS t(f)",
)
def l4(spark, sf_dir):
    return ML.split_counts(_steps(spark, sf_dir)[1], FEATURES)


@query(
    "l5_bounded_on_known_logistic",
    f"{SQL_OBS} SELECT count(*) AS n, round(min({_sql_logistic()}), {DIGITS}) AS lowest, round(max({_sql_logistic()}), {DIGITS}) AS highest, 0.0::DOUBLE AS mae FROM obs",
)
def l5(spark, sf_dir):
    rows, model = _logistic(spark, sf_dir)
    scored = ML.score(model, rows, "y_pred")
    return rounded(
        scored.agg(
            F.count(F.lit(1)).alias("n"),
            F.min("y_pred").alias("lowest"),
            F.max("y_pred").alias("highest"),
            F.avg(F.abs(F.col("y_pred") - F.col(LABEL))).alias("mae"),
        ),
        DIGITS,
    )


# At full physics weight a value below 0.2 pays 0.1 for every unit it lacks, so a row's loss is least 0.05 above its label.
@query(
    "l5_physics_loss_optimum",
    f"{SQL_OBS} SELECT event_id, round(CASE WHEN n_jets = 2 THEN 0.1 + 0.1 / 2 ELSE 0.9 END::DOUBLE, {DIGITS}) AS predicted FROM obs",
)
def l5_physics(spark, sf_dir):
    crowded = F.when(F.col("n_jets") > 2, 1.0).otherwise(0.0).alias("crowded")
    rows = stage(_rows(spark, sf_dir, "CASE WHEN n_jets = 2 THEN 0.1D ELSE 0.9D END").select("*", crowded))
    model = train_on_physics_loss(rows, ["crowded", "delta_phi", "pt_balance"], LABEL, PhysicsFitConfig(physics_weight=1.0))
    return rounded(ML.score(model, rows, "predicted").select("event_id", "predicted"), DIGITS)


@query("l6_training_flow_on_steps", "SELECT 'validation' AS part, 0.0::DOUBLE AS mse, 1.0::DOUBLE AS r2 UNION ALL SELECT 'test', 0.0::DOUBLE, 1.0::DOUBLE")
def l6(spark, sf_dir):
    table = add_features(observed(spark, sf_dir)).withColumn(flows.TARGET, F.expr(STEPS))
    result = flows.train(table, config=ALL_FEATURES)
    test = ML.regression_metrics(result.test_predictions, "y_true", "y_pred")
    parts = {"validation": result.validation_metrics, "test": test}
    of = [m.select(F.lit(p).alias("part"), F.col("val_mse").alias("mse"), F.col("val_r2").alias("r2")) for p, m in parts.items()]
    return rounded(of[0].unionByName(of[1]))


@query(
    "l7_inference_on_known_logistic",
    f"{sql_observed(source=SQL_NESTED)} SELECT event_id, round({_sql_logistic()}, {DIGITS}) AS bounded FROM obs",
)
def l7(spark, sf_dir):
    rows = _rows(spark, sf_dir, _sql_logistic())
    scaler = FeatureScaler("robust").fit(rows, FEATURES)
    model = ML.train_bounded(scaler.transform(rows), FEATURES, LABEL)
    path, source = stage_path(spark, "bundle"), stage_path(spark, "events")
    flows.save_bundle(spark, flows.InferenceBundle({"bounded": model}, FEATURES, scaler), path)
    nested_events(spark, sf_dir).write.parquet(source)
    return rounded(flows.infer(spark, source, flows.load_bundle(spark, path)).select("event_id", "bounded"), DIGITS)


@query(
    "l8_models_on_known_logistic",
    f"{SQL_OBS} SELECT event_id, round({_sql_logistic()}, {DIGITS}) AS all_features, round({_sql_logistic()}, {DIGITS}) AS one_feature FROM obs",
)
def l8(spark, sf_dir):
    rows, model = _logistic(spark, sf_dir)
    models = {
        "all_features": model,
        "one_feature": ML.train_bounded(rows, ["n_jets"], LABEL),
        "unusable": ML.train_bounded(rows.withColumn("absent", F.col("mjj")), ["absent"], LABEL),
    }
    scored, used = ML.score_all(models, rows)
    return rounded(scored.select("event_id", *used), DIGITS)


@query(
    "s18_saved_model_on_known_logistic",
    f"{SQL_OBS} SELECT event_id, round({_sql_logistic()}, {DIGITS}) AS predicted, '{LABEL}' AS target FROM obs",
)
def s18(spark, sf_dir):
    rows, model = _logistic(spark, sf_dir)
    path = stage_path(spark, "model")
    ML.save_model(model, path, {"target": LABEL})
    loaded, metadata = ML.load_model(path)
    return rounded(ML.score(loaded, rows, "predicted").select("event_id", "predicted", F.lit(metadata["target"]).alias("target")), DIGITS)


@query(
    "i1_sensitivity_of_known_logistic",
    f"{SQL_OBS} SELECT 'n_jets' AS feature, round(avg(abs({_sql_logistic('n_jets * 1.1')} - {_sql_logistic()})) / 0.1, {DIGITS}) AS mean_sensitivity FROM obs"
    f" UNION ALL SELECT f, 0.0::DOUBLE FROM (VALUES {_OTHERS}) AS t(f)",
)
def i1(spark, sf_dir):
    rows, model = _logistic(spark, sf_dir)
    return rounded(prediction_sensitivity(model, rows, FEATURES), DIGITS)


@query("m9_tree_importance_on_steps", f"SELECT 'n_jets' AS feature, 1.0::DOUBLE AS score UNION ALL SELECT f, 0.0::DOUBLE FROM (VALUES {_OTHERS}) AS t(f)")
def m9(spark, sf_dir):
    return rounded(tree_importance_scores(_rows(spark, sf_dir, STEPS), FEATURES, LABEL))


def _planted(name: str, method: str):
    @query(name, f"{SQL_OBS} SELECT event_id, TRUE AS is_anomaly FROM obs WHERE event_id % {PLANTED} = 0")
    def run(spark, sf_dir):
        planted = F.col("event_id") % PLANTED == 0
        rows = observed(spark, sf_dir).select("event_id", *[F.when(planted, F.col(f) * 100 + 1e5).otherwise(F.col(f)).alias(f) for f in FEATURES])
        rows = stage(rows)
        detector = AN.AnomalyDetector(method)
        detector.fit(training_share(rows), FEATURES)
        verdicts = stage(detector.detect(rows).select("event_id", "is_anomaly"))
        # Ordinary rows may be flagged up to twice the detector's share of all rows; beyond it every flagged row shows.
        counts = verdicts.agg(F.count_if(F.col("is_anomaly") & ~planted).alias("flagged"), F.count(F.lit(1)).alias("scored")).first()
        too_many = counts["flagged"] > 2 * detector.contamination * counts["scored"]
        return verdicts.where(F.col("is_anomaly") & (planted | F.lit(too_many)))


_planted("n1_forest_finds_planted", "isolation_forest")
_planted("n2_envelope_finds_planted", "elliptic_envelope")


@query("n2_envelope_sees_a_third_in_a_cluster", f"{SQL_OBS} SELECT event_id FROM obs WHERE event_id % 10 < 3")
def n2_cluster(spark, sf_dir):
    # Three tenths of all rows in one small cluster drag the moments of all rows to it. Rows as far out as the nearest
    # planted one come back: an ordinary row shows if the estimate follows the cluster.
    names = ["delta_phi", "pt_balance", "eta_centrality"]
    planted = F.col("event_id") % 10 < 3
    moved = {f: F.when(planted, 10.0 + F.col(f) * 0.01).otherwise(F.col(f)) for f in names}
    rows = stage(observed(spark, sf_dir).select("event_id", *[c.alias(f) for f, c in moved.items()]))
    detector = AN.AnomalyDetector("elliptic_envelope")
    detector.fit(training_share(rows), names)
    scored = stage(detector.detect(rows).select("event_id", "anomaly_score"))
    nearest = scored.where(planted).agg(F.min("anomaly_score")).first()[0]
    return scored.where(F.col("anomaly_score") >= F.lit(nearest)).select("event_id")


def _plane(spark, sf_dir):
    """Ten columns that are linear in two, so eight components rebuild them, and a reconstruction detector."""
    a, b = F.col("pt_balance"), F.col("delta_phi")
    names = [f"x{k}" for k in range(10)]
    rows = stage(observed(spark, sf_dir).select("event_id", *[((k + 1) * a + (10 - k) * (-1) ** k * b).alias(n) for k, n in enumerate(names)]))
    detector = AN.AnomalyDetector("reconstruction")
    detector.fit(training_share(rows), names)
    return rows, detector


@query("n3_no_error_in_a_plane", f"{SQL_OBS} SELECT event_id, 0.0::DOUBLE AS anomaly_score FROM obs")
def n3(spark, sf_dir):
    rows, detector = _plane(spark, sf_dir)
    return rounded(detector.detect(rows).select("event_id", "anomaly_score"))


@query("n3_fourier_sees_the_centre", f"{SQL_OBS} SELECT event_id FROM obs WHERE event_id % {PLANTED} = 0")
def n3_centre(spark, sf_dir):
    # Rows lie on a circle, planted ones at its centre. Rows with as high a score as the lowest planted one come back.
    planted = F.col("event_id") % PLANTED == 0
    angle = F.col("delta_phi") * 1000.0
    moved = [F.when(planted, 0.0).otherwise(c).alias(f) for f, c in (("a", F.cos(angle)), ("b", F.sin(angle)))]
    rows = stage(observed(spark, sf_dir).select("event_id", *moved))
    detector = AN.AnomalyDetector("fourier")
    detector.fit(training_share(rows), ["a", "b"])
    scored = stage(detector.detect(rows).select("event_id", "anomaly_score"))
    lowest = scored.where(planted).agg(F.min("anomaly_score")).first()[0]
    return scored.where(F.col("anomaly_score") >= F.lit(lowest)).select("event_id")


@query("n4_quality_in_a_plane", f"{SQL_OBS} SELECT event_id, 0.0::DOUBLE AS total_reconstruction_error, 0.0::DOUBLE AS max_feature_error, 0.0::DOUBLE AS mean_absolute_error FROM obs")
def n4(spark, sf_dir):
    rows, detector = _plane(spark, sf_dir)
    quality = detector.reconstruction_quality(rows)
    return rounded(quality.select("event_id", "total_reconstruction_error", "max_feature_error", "mean_absolute_error"))
