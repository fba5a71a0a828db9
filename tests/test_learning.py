"""Scaling, feature selection, splits, models, anomaly detectors and flows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from jetloom.operators import anomaly as AN
from jetloom.operators import feature_selection as FS
from jetloom.operators import models as ML
from jetloom.operators.features import TARGET_PROXIES, add_features
from jetloom.operators.interpret import prediction_sensitivity
from jetloom.operators.scaling import FeatureScaler, ScalerFit
from jetloom.operators.splits import add_split, training_share
from jetloom.operators.topk import first_by_key
from jetloom.plans import flows
from workloads import base as B

RNG = np.random.default_rng(17)
N = 600


@pytest.fixture(scope="module")
def table(spark):
    x = RNG.normal(size=(N, 3))
    y = 1 / (1 + np.exp(-(1.5 * x[:, 0] - 0.5 * x[:, 1])))
    rows = [(i, *map(float, r), float(t), 5.0) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "event_id bigint, a double, b double, c double, y double, flat double").cache()


FEATURES = ["a", "b", "c"]


@pytest.mark.parametrize("method", ["robust", "standard", "minmax"])
def test_scalers_match_numpy_and_invert(table, method):
    scaler = FeatureScaler(method)
    with pytest.raises(ValueError):
        scaler.transform(table)
    scaled = scaler.fit_transform(table, [*FEATURES, "flat"])
    x = table.orderBy("event_id").toPandas()[FEATURES].to_numpy()
    got = scaled.orderBy("event_id").toPandas()
    if method == "robust":
        want = (x - np.median(x, axis=0)) / (np.quantile(x, 0.75, axis=0) - np.quantile(x, 0.25, axis=0))
    elif method == "standard":
        want = (x - x.mean(axis=0)) / x.std(axis=0)
    else:
        want = (x - x.min(axis=0)) / (x.max(axis=0) - x.min(axis=0))
    np.testing.assert_allclose(got[FEATURES], want, rtol=1e-9, atol=1e-12)
    assert (got["flat"] == 0).all()  # a constant column is centred and keeps scale 1
    back = scaler.inverse_transform(scaled).orderBy("event_id").toPandas()
    np.testing.assert_allclose(back[FEATURES], x, rtol=1e-9, atol=1e-12)


def test_scaler_round_trip_and_unknown_method(spark, table, tmp_path):
    fit = FeatureScaler("minmax").fit(table, FEATURES)
    fit.save(spark, str(tmp_path / "scaler"))
    assert ScalerFit.load(spark, str(tmp_path / "scaler")) == fit
    with pytest.raises(ValueError):
        FeatureScaler("other")
    with pytest.raises(ValueError):
        FeatureScaler("standard").fit(table.limit(0), FEATURES)


def test_f_scores(table):
    df = table.toPandas()
    got = {r["feature"]: r["score"] for r in FS.f_scores(table, [*FEATURES, "flat"], "y").collect()}
    for f in FEATURES:
        r2 = np.corrcoef(df[f], df["y"])[0, 1] ** 2
        assert got[f] == pytest.approx(r2 * (N - 2) / (1 - r2))
    assert got["flat"] is None


def test_mutual_information(table):
    got = {r["feature"]: r["score"] for r in FS.mutual_information_scores(table, FEATURES, "y", bins=8).collect()}
    df = table.toPandas()
    grid = [i / 8 for i in range(1, 8)]

    def bins(v):
        return np.searchsorted(np.quantile(v, grid), v, side="right")

    for f in FEATURES:
        joint = np.zeros((8, 8))
        np.add.at(joint, (bins(df[f]), bins(df["y"])), 1 / N)
        px, py = joint.sum(axis=1, keepdims=True), joint.sum(axis=0, keepdims=True)
        want = np.nansum(np.where(joint > 0, joint * np.log(np.where(joint > 0, joint, 1) / (px * py)), 0))
        assert got[f] == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("method, options", [("mutual_info", {}), ("f_regression", {}), ("tree_importance", {"num_trees": 5, "max_depth": 4})])
def test_selector(table, method, options):
    selector = FS.FeatureSelector(method, k=2, **options)
    with pytest.raises(ValueError):
        selector.ranking()
    selector.fit(table, FEATURES, "y")
    assert selector.selected == ["a", "b"]
    assert selector.ranking().first()["feature"] == "a"
    assert selector.transform(table, keep=["event_id"]).columns == ["event_id", "a", "b"]
    with pytest.raises(ValueError):
        FS.FeatureSelector("other")


def test_split_is_complete_balanced_and_stable(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "event_id")
    one = {r["event_id"]: r["split"] for r in add_split(ids.repartition(1)).collect()}
    many = {r["event_id"]: r["split"] for r in add_split(ids.repartition(31)).collect()}
    assert one == many and len(one) == 20_000
    share = {s: sum(v == s for v in one.values()) / 20_000 for s in ("train", "validation", "test")}
    assert share["test"] == pytest.approx(0.2, abs=0.015)
    assert share["validation"] == pytest.approx(0.16, abs=0.015)
    # Neighbouring ids do not fall into runs.
    flips = sum(one[i] != one[i + 1] for i in range(19_999))
    assert flips > 5_000
    other = {r["event_id"]: r["split"] for r in add_split(ids, seed=7).collect()}
    assert other != one
    big = spark.createDataFrame([(2**62,), (-5,)], "event_id bigint")
    assert add_split(big).count() == 2


def test_first_by_key_is_exact_on_long_tables(spark):
    ids = spark.range(0, 30_000).select((F.col("id") * 7919 % 30_011).alias("event_id"))
    smallest = sorted(r["event_id"] for r in ids.collect())[:100]
    assert [r["event_id"] for r in first_by_key(ids, "event_id", 100).collect()] == smallest
    copies = ids.withColumn("event_id", F.when(F.col("event_id") % 3 == 0, -1).otherwise(F.col("event_id")))
    got = [r["event_id"] for r in first_by_key(copies, "event_id", 100).collect()]
    assert got == [-1] * 100


def test_training_share_follows_the_table(spark):
    ids = spark.range(0, 30_000).withColumnRenamed("id", "event_id")
    kept = training_share(ids, 0.5)
    assert abs(kept.count() - 15_000) < 500
    again = training_share(ids.repartition(7), 0.5)
    assert kept.exceptAll(again).count() == 0 and again.count() == kept.count()


# ---------------------------------------------------------------- models


@pytest.fixture(scope="module")
def boosted(table):
    rows = add_split(table).where("split != 'test'").withColumn("held", F.col("split") == "validation")
    config = ML.BoostedTreesConfig(rounds=5, max_depth=3)
    return ML.train_boosted_trees(rows, FEATURES, "y", "held", config)


def test_boosted_trees(table, boosted):
    scored = ML.score(boosted, table, "p")
    assert scored.columns == [*table.columns, "p"]
    quality = ML.regression_metrics(scored, "y", "p").first()
    assert quality["val_r2"] > 0.5 and quality["val_rmse"] == pytest.approx(quality["val_mse"] ** 0.5)
    counts = {r["feature"]: r["importance"] for r in ML.split_counts(boosted, FEATURES).collect()}
    debug = boosted.stages[-1].toDebugString
    assert counts == {f: debug.count(f"If (feature {i} ") for i, f in enumerate(FEATURES)}


def test_patience_sees_past_a_plateau():
    falling = [1.0, 0.9, 0.9, 0.95, 0.9, 0.5, 0.6, 0.6, 0.6]
    assert ML.patience_cut(falling, 4) == (6, False)  # falls again within the patience
    assert ML.patience_cut(falling, 3) == (2, True)
    assert ML.patience_cut(falling + [0.6], 4) == (6, True)
    assert ML.patience_cut([0.3, 0.0], 50) == (2, True)
    assert ML.patience_cut([], 3) == (0, False) and ML.patience_cut([float("nan")], 3) == (0, False)


def test_boosting_waits_and_keeps_the_best_round(spark, table, monkeypatch):
    rows = add_split(table).where("split != 'test'").withColumn("held", F.col("split") == "validation")
    noisy = rows.withColumn("y", F.col("y") + (F.pmod(F.xxhash64("event_id"), F.lit(1000)) - 500) / 1000)
    monkeypatch.setattr(ML, "FIRST_ROUNDS", 4)
    seen = []
    cut = ML.patience_cut
    monkeypatch.setattr(ML, "patience_cut", lambda errors, patience: seen.append((list(errors), cut(errors, patience))) or seen[-1][1])
    model = ML.train_boosted_trees(noisy, FEATURES, "y", "held", ML.BoostedTreesConfig(rounds=40, max_depth=5, patience=5, learning_rate=0.5))
    errors, (best, waited) = seen[-1]
    assert waited and len(seen) > 1 and best == model.stages[-1].getNumTrees < len(errors)
    for shorter, _ in seen[:-1]:
        assert errors[: len(shorter)] == pytest.approx(shorter, rel=1e-9)  # a longer run repeats the shorter one
    held = ML.regression_metrics(ML.score(model, noisy.where("held"), "p"), "y", "p").first()
    assert held["val_mse"] == pytest.approx(min(errors), rel=1e-9)


def test_bounded_regressor_stays_in_bounds(spark, table):
    model = ML.train_bounded(table, FEATURES, "y")
    wild = table.withColumn("a", F.col("a") * 100)
    low, high = ML.score(model, wild, "p").agg(F.min("p"), F.max("p")).first()
    assert 0.0 <= low < high <= 1.0
    rows = {r["feature"]: r["mean_sensitivity"] for r in prediction_sensitivity(model, table, FEATURES).collect()}
    base = ML.score(model, table, "p").select("event_id", "p")
    moved = ML.score(model, table.withColumn("a", F.col("a") * 1.1), "q").select("event_id", "q")
    want = base.join(moved, "event_id").agg(F.avg(F.abs(F.col("p") - F.col("q")) / 0.1)).first()[0]
    assert rows["a"] == pytest.approx(want, rel=1e-9) and rows["a"] > rows["b"] > rows["c"]


def test_failing_model_is_skipped_and_models_reload(spark, table, tmp_path):
    good = ML.train_bounded(table, FEATURES, "y")
    bad = ML.train_bounded(table.withColumnRenamed("a", "gone"), ["gone"], "y")
    scored, used = ML.score_all({"good": good, "bad": bad}, table)
    assert used == ["good"] and "bad" not in scored.columns
    ML.save_model(good, str(tmp_path / "m"), {"kind": "bounded"})
    loaded, metadata = ML.load_model(str(tmp_path / "m"))
    assert metadata == {"kind": "bounded"}
    a = ML.score(good, table, "p").orderBy("event_id").select("p").toPandas()
    b = ML.score(loaded, table, "p").orderBy("event_id").select("p").toPandas()
    np.testing.assert_allclose(a, b)


# ---------------------------------------------------------------- anomalies


@pytest.fixture(scope="module")
def contaminated(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2000, 10)) @ np.diag(np.linspace(0.5, 3, 10))
    x[:, 9] = x[:, 0] + x[:, 1] + 0.01 * rng.normal(size=2000)
    planted = np.arange(0, 2000, 100)
    x[planted] += rng.choice([-1, 1], size=(20, 10)) * 10 * x.std(axis=0)
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    names = [f"f{i}" for i in range(10)]
    return spark.createDataFrame(rows, ["event_id", *names]).cache(), names, set(planted.tolist())


@pytest.mark.parametrize("method", AN.METHODS)
def test_planted_outliers_are_found(contaminated, method):
    df, names, planted = contaminated
    detector = AN.AnomalyDetector(method)
    with pytest.raises(ValueError):
        detector.detect(df)
    detector.fit(df, names)
    rows = detector.detect(df).select("event_id", "anomaly_score", "is_anomaly").collect()
    flagged = {r["event_id"] for r in rows if r["is_anomaly"]}
    assert len(rows) == 2000 and 90 <= len(flagged) <= 100
    if method == "reconstruction":
        # Outliers inside the code's own directions rebuild well: most, not all, stand out.
        assert len(planted & flagged) >= 15
    else:
        assert planted <= flagged
    again = AN.AnomalyDetector(method)
    again.fit(df.repartition(9), names)
    assert again.threshold == pytest.approx(detector.threshold, rel=1e-6)


def test_tree_samples_follow_one_law(spark):
    rows = spark.range(30_000).select(F.col("id").alias("event_id"), F.rand(1).alias("f"))
    drawn = AN.draw_tree_samples(rows, ["f"], "event_id", trees=10, size=64, seed=1)
    per_tree = {r["tree"]: r["count"] for r in drawn.groupBy("tree").count().collect()}
    assert per_tree == {t: 64 for t in range(10)}
    assert 600 < drawn.select("event_id").distinct().count() <= 640
    short = AN.draw_tree_samples(rows.limit(100), ["f"], "event_id", trees=10, size=64, seed=1)
    assert short.count() == 640 and short.select("event_id").distinct().count() == 100
    copies = rows.withColumn("event_id", F.lit(1).cast("bigint"))
    hot = AN.draw_tree_samples(copies, ["f"], "event_id", trees=10, size=64, seed=1)
    assert {r["count"] for r in hot.groupBy("tree").count().collect()} == {64}
    # Dropping tickets early does not change the draw.
    everything = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn(
        "t", F.pmod(F.xxhash64("event_id", "f", "tree", F.lit(1)), F.lit(AN.TICKETS).cast("bigint"))
    )
    lowest = everything.groupBy("tree").agg(F.slice(F.array_sort(F.collect_list(F.struct("t", "event_id"))), 1, 64).alias("s"))
    want = lowest.select("tree", F.explode("s").alias("s")).select("tree", "s.event_id")
    assert want.exceptAll(drawn.select("tree", "event_id")).count() == 0


def test_two_detectors_on_repeated_ids(contaminated):
    df, names, _ = contaminated
    rows = df.withColumn("event_id", F.lit(1).cast("bigint"))
    detectors = [AN.AnomalyDetector("reconstruction"), AN.AnomalyDetector("elliptic_envelope")]
    for detector in detectors:
        detector.fit(df, names)
    assert AN.detect_both(*detectors, rows).count() == df.count()
    stored = [d.detect(rows) for d in detectors]
    with pytest.raises(Exception, match="repeated id"):
        AN.compare_detectors(*stored).collect()


def test_tree_importance_keeps_rows_with_missing_values(spark):
    # The feature says when the target is large by being absent.
    df = spark.range(400).select(
        F.when(F.col("id") % 2 == 0, F.lit(3.0)).alias("gap"),
        F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).otherwise(1.0).alias("noise"),
        (F.col("id") % 2).cast("double").alias("y"),
    )
    scores = {r["feature"]: r["score"] for r in FS.tree_importance_scores(df, ["gap", "noise"], "y", num_trees=5).collect()}
    assert scores["gap"] > 0.95


def test_reconstruction_quality(contaminated):
    df, names, _ = contaminated
    detector = AN.AnomalyDetector("reconstruction")
    detector.fit(df, names)
    r = detector.reconstruction_quality(df).first()
    assert r["total_reconstruction_error"] == pytest.approx(np.mean(r["feature_wise_errors"]))
    assert r["max_feature_error"] == max(r["feature_wise_errors"])
    z = [(r[n] - c) / s for n, (c, s) in detector.scaler.parameters.items()]
    back = [(v - c) / s for v, (c, s) in zip(r["reconstructed_features"], detector.scaler.parameters.values())]
    np.testing.assert_allclose(np.square(np.subtract(z, back)), r["feature_wise_errors"], atol=1e-9)
    with pytest.raises(ValueError):
        AN.AnomalyDetector("isolation_forest").reconstruction_quality(df)


def test_voting(spark):
    df = spark.createDataFrame([(1, 0.2, 0.4, True, False), (2, 0.9, 0.7, True, True)], ["event_id", "s1", "s2", "f1", "f2"])

    def votes(kind):
        out = AN.combine_votes(df, ["s1", "s2"], ["f1", "f2"], kind).orderBy("event_id").collect()
        return [r["ensemble_anomaly"] for r in out]

    assert votes("majority") == votes("unanimous") == [False, True]  # more than half of two is both
    assert votes("any") == [True, True]
    with pytest.raises(ValueError):
        votes("few")


# ---------------------------------------------------------------- flows


def test_training_flow_keeps_the_target_out(spark, sf_dir):
    table = add_features(B.observed(spark, sf_dir))
    result = flows.train(table, config=ML.BoostedTreesConfig(rounds=3, max_depth=3))
    assert not {"cos_theta_star", *TARGET_PROXIES} & set(result.features)
    assert result.evaluation.count() == 56
    assert {r["feature"] for r in result.importance.collect()} == set(result.features)
    assert result.validation_metrics.first()["val_rmse"] > 0
    leaky = flows.train(table, exclude=(), config=ML.BoostedTreesConfig(rounds=10, max_depth=4))
    assert leaky.validation_metrics.first()["val_r2"] > 0.5


def test_bundle_round_trip(spark, table, tmp_path):
    rows = table.select("event_id", "y", *FEATURES)
    scaler = FeatureScaler("robust").fit(rows, FEATURES)
    scaled = scaler.transform(rows)
    detector = AN.AnomalyDetector("isolation_forest")
    detector.fit(scaled, FEATURES)
    models = {"bounded": ML.train_bounded(scaled, FEATURES, "y"), "broken": ML.train_bounded(scaled, ["a"], "y")}
    bundle = flows.InferenceBundle(models, FEATURES, scaler, detector)
    flows.save_bundle(spark, bundle, str(tmp_path / "b"))
    for part in (tmp_path / "b" / "models" / "broken" / "model" / "metadata").iterdir():
        part.unlink()
    loaded = flows.load_bundle(spark, str(tmp_path / "b"))
    assert loaded.skipped == ["broken"] and loaded.features == FEATURES
    names = ["bounded", "anomaly_detector_scores", "anomaly_detector_predictions"]
    a = bundle.predict(rows).orderBy("event_id").select(*names).toPandas()
    b = loaded.predict(rows).orderBy("event_id").select(*names).toPandas()
    np.testing.assert_allclose(a.to_numpy(dtype=float), b.to_numpy(dtype=float), rtol=1e-9)


@pytest.mark.parametrize("method", ["elliptic_envelope", "reconstruction"])
def test_detectors_reload(spark, contaminated, tmp_path, method):
    df, names, _ = contaminated
    detector = AN.AnomalyDetector(method)
    with pytest.raises(ValueError):
        detector.save(spark, str(tmp_path / "d"))
    detector.fit(df, names)
    detector.save(spark, str(tmp_path / "d"))
    again = AN.AnomalyDetector.load(spark, str(tmp_path / "d"))
    a = detector.detect(df).orderBy("event_id").select("anomaly_score").toPandas()
    b = again.detect(df).orderBy("event_id").select("anomaly_score").toPandas()
    np.testing.assert_allclose(a, b)


@pytest.mark.parametrize("name", ["n1_forest_finds_planted", "n2_envelope_finds_planted"])
def test_planted_queries_see_every_verdict(spark, sf_dir, monkeypatch, name):
    """A detector that flags every row, or none, does not give what the SQL expects."""
    from workloads import known_labels, registry

    run = registry()[name].run
    expected = {r.event_id for r in known_labels.observed(spark, sf_dir).select("event_id").where(f"event_id % {known_labels.PLANTED} = 0").collect()}
    assert expected and {r.event_id for r in run(spark, sf_dir).collect()} == expected
    for flag in (True, False):
        monkeypatch.setattr(AN.AnomalyDetector, "detect", lambda self, rows: rows.withColumn("is_anomaly", F.lit(flag)))
        assert {r.event_id for r in run(spark, sf_dir).collect()} != expected


def test_registered_boosting_uses_the_defaults(spark, sf_dir, monkeypatch):
    from workloads import learning

    seen = []
    monkeypatch.setattr(ML, "GBTRegressor", lambda **given: seen.append(given) or 1 / 0)
    monkeypatch.setattr(flows, "train", lambda table, **given: seen.append(given) or 1 / 0)
    for run in (learning.l1, learning.l2, learning.l4, learning.l6):
        with pytest.raises(ZeroDivisionError):
            run(spark, sf_dir)
    assert [(g["maxDepth"], g["maxIter"]) for g in seen[:3]] == [(6, 1000)] * 3 and seen[3] == {}


def test_unconverged_bounded_fit_is_reported(table, caplog):
    ML.train_bounded(table, FEATURES, "y", max_iter=1)
    assert "stopped after 1 iterations" in caplog.text
    caplog.clear()
    ML.train_bounded(table, FEATURES, "y")
    assert caplog.text == ""


def test_concentration_steps_go_on_to_convergence(spark, monkeypatch):
    """More than ten steps while the determinant falls."""
    steps = []

    def moments(rows, vector):
        steps.append(len(steps))
        return 100, np.zeros(2), np.eye(2) * max(2.0 ** -len(steps), 2.0**-15)

    monkeypatch.setattr(AN, "vector_moments", moments)
    AN.robust_covariance(spark.range(100).select(F.array(F.rand(1), F.rand(2)).alias("v")), "v")
    assert len(steps) == 17


def test_boosting_that_keeps_falling_goes_to_its_last_round_at_once(spark, table, monkeypatch):
    rows = add_split(table).where("split != 'test'").withColumn("held", F.col("split") == "validation")
    monkeypatch.setattr(ML, "FIRST_ROUNDS", 2)
    runs = []
    monkeypatch.setattr(ML, "patience_cut", lambda errors, patience: runs.append(len(errors)) or (len(errors), False))
    model = ML.train_boosted_trees(rows, FEATURES, "y", "held", ML.BoostedTreesConfig(rounds=24, max_depth=2, patience=3))
    assert runs == [2, 5, 24] and model.stages[-1].getNumTrees == 24
    config = ML.BoostedTreesConfig()
    assert ML.next_rounds(60, 55, config) == 120  # a plateau: the patience may run out soon
    assert ML.next_rounds(10, 10, config) < ML.next_rounds(60, 60, config) == config.rounds


def test_boosting_takes_no_more_partitions_than_cores(spark):
    many = spark.range(0, 4000, 1, 200).withColumnRenamed("id", "event_id")
    few = ML._few_partitions(many, 10)
    assert few.rdd.getNumPartitions() == min(200, spark.sparkContext.defaultParallelism) and few.count() == 4000
