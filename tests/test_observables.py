"""Formulas against NumPy, invariants and engineered features."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from jetloom.functions import kinematics as K
from jetloom.functions.interpretation import interpret_correlation
from jetloom.operators import features as FE
from jetloom.operators.observables import add_boost_invariants, add_observables, self_pair_observables
from jetloom.schema import EVENT, PAIR_COLUMNS


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(5)
    n = 300
    data = {"event_id": np.arange(n)}
    for s in ("leading", "subleading"):
        data[f"{s}_jet_pt"] = rng.uniform(50, 900, n)
        data[f"{s}_jet_eta"] = rng.uniform(-4, 4, n)
        data[f"{s}_jet_phi"] = rng.uniform(-math.pi, math.pi, n)
        data[f"{s}_jet_m"] = rng.uniform(0, 60, n)
    return data


@pytest.fixture(scope="module")
def pairs(spark, sample):
    rows = list(zip(*[v.tolist() for v in sample.values()]))
    return spark.createDataFrame(rows, list(sample))


def numpy_mass(d):
    total = np.zeros((4, len(d["event_id"])))
    for s in ("leading", "subleading"):
        pt, eta, phi, m = (d[f"{s}_jet_{f}"] for f in ("pt", "eta", "phi", "m"))
        p = np.array([pt * np.cos(phi), pt * np.sin(phi), pt * np.sinh(eta)])
        total += np.vstack([p, np.sqrt((p**2).sum(axis=0) + m**2)])
    return np.sqrt(np.maximum(total[3] ** 2 - (total[:3] ** 2).sum(axis=0), 0))


def test_observables_match_numpy(pairs, sample):
    got = add_observables(pairs).orderBy("event_id").toPandas()
    d_eta = np.abs(sample["leading_jet_eta"] - sample["subleading_jet_eta"])
    d_phi = sample["leading_jet_phi"] - sample["subleading_jet_phi"]
    np.testing.assert_allclose(got["mjj"], numpy_mass(sample), rtol=1e-7)
    np.testing.assert_allclose(got["delta_y"], d_eta)
    np.testing.assert_allclose(got["delta_phi"], np.abs(np.arctan2(np.sin(d_phi), np.cos(d_phi))), atol=1e-12)
    np.testing.assert_allclose(got["chi"], np.exp(d_eta))
    np.testing.assert_allclose(got["cos_theta_star"], np.tanh(d_eta / 2), atol=1e-12)
    assert got["delta_phi"].between(0, math.pi).all() and got["cos_theta_star"].between(0, 1, inclusive="left").all()


def test_symmetric_under_swap(pairs):
    swapped = pairs.select(
        "event_id",
        *[
            F.col(c).alias(c.replace("subleading", "leading") if c.startswith("sub") else "sub" + c)
            for c in PAIR_COLUMNS
        ],
    )
    names = ["mjj", "delta_y", "delta_phi", "chi", "cos_theta_star", "dijet_pt"]
    a = add_observables(pairs).orderBy("event_id").select(*names).toPandas()
    b = add_observables(swapped).orderBy("event_id").select(*names).toPandas()
    np.testing.assert_allclose(a, b, rtol=1e-12)


def test_special_pairs(spark):
    rows = [
        ("wrap", 100.0, 0.0, 3.1, 0.0, 100.0, 0.0, -3.1, 0.0),
        ("same", 100.0, 1.0, 0.5, 10.0, 100.0, 1.0, 0.5, 10.0),
        ("back", 100.0, 0.0, 0.0, 0.0, 100.0, 0.0, math.pi, 0.0),
    ]
    got = {r["event_id"]: r for r in add_observables(spark.createDataFrame(rows, ["event_id", *PAIR_COLUMNS])).collect()}
    assert got["wrap"]["delta_phi"] == pytest.approx(2 * math.pi - 6.2)
    assert got["same"]["mjj"] == pytest.approx(20.0) and got["same"]["cos_theta_star"] == 0.0
    assert got["back"]["mjj"] == pytest.approx(200.0)


def test_self_pairs_are_degenerate(spark):
    events = spark.createDataFrame([(1, [(90.0, 1.0, 0.3, 7.0, 1.0)])], EVENT)
    jet = events.select(F.inline(self_pair_observables(F.col("jets")))).first()
    assert (jet["delta_y"], jet["chi"], jet["cos_theta_star"], jet["pt_balance"]) == (0.0, 1.0, 0.0, 1.0)
    assert jet["mjj"] == pytest.approx(14.0) and jet["average_pt"] == 90.0


def test_weights_and_corrections(spark):
    df = spark.createDataFrame([(1000.0, "qq", 0.5), (1000.0, "zz", 0.5), (0.0, "gg", 0.5)], ["mjj", "process", "c"])
    rows = df.select(
        K.cross_section_weight("mjj", F.col("process")).alias("w"),
        K.cross_section_weight("mjj", "unheard of").alias("plain"),
        K.parton_correction("c", "mjj").alias("p"),
    ).collect()
    assert rows[0]["w"] == pytest.approx(0.4 / 1000**4.3)
    assert rows[1]["w"] == rows[1]["plain"] == pytest.approx(1000**-4.5)
    assert rows[2]["w"] is None
    assert rows[0]["p"] == pytest.approx(0.5 * (1 + 0.1 * math.exp(-1)) * 1.025)


def test_features(pairs):
    table = FE.add_features(add_observables(pairs))
    r = table.first()
    assert r["log_mjj"] == pytest.approx(math.log(r["mjj"])) and r["log_chi"] == pytest.approx(r["delta_y"])
    assert r["harmonic_mean_pt"] == pytest.approx(
        2 * r["leading_jet_pt"] * r["subleading_jet_pt"] / r["dijet_pt"]
    )
    assert r["boost_invariant"] == pytest.approx(r["delta_y"] / (1 + abs(r["eta_centrality"])))
    names = FE.feature_columns(table)
    assert "cos_theta_star" not in names and "event_id" not in names and len(names) == 31 - 1
    assert not set(FE.TARGET_PROXIES) & set(FE.feature_columns(table, FE.TARGET_PROXIES))


def test_features_follow_their_inputs(spark):
    only_mass = FE.add_features(spark.createDataFrame([(1, 0.0)], ["event_id", "mjj"]))
    assert only_mass.columns == ["event_id", "mjj", "log_mjj"]
    assert only_mass.first()["log_mjj"] is None
    assert FE.add_features(spark.createDataFrame([(1,)], ["event_id"])).columns == ["event_id"]
    zero = spark.createDataFrame([(0.0, 0.0)], ["leading_jet_pt", "subleading_jet_pt"])
    r = FE.add_features(zero).first()
    assert r["pt_ratio"] is None and r["harmonic_mean_pt"] is None
    late = FE.add_features(spark.createDataFrame([(1.0, 2.0)], ["eta_centrality", "delta_y"]))
    assert late.first()["boost_invariant"] == 1.0


def test_boost_invariants_need_inputs(spark, pairs):
    out = add_boost_invariants(add_observables(pairs))
    assert {"invariant_ht", "boost_weight"} <= set(out.columns)
    bare = spark.createDataFrame([(1.0,)], ["delta_y"])
    assert add_boost_invariants(bare).columns == ["delta_y"]


@pytest.mark.parametrize(
    "feature, r, start, end",
    [
        ("delta_y", 0.9, "Strong Rapidity", "Unexpected positive correlation with cos θ*"),
        ("mjj", -0.4, "Moderate Dijet mass", "more central scattering"),
        ("chi", -0.2, "Weak Chi variable", "(more central scattering)"),
        ("pt_balance", 0.0, "Very weak pT balance shows negative", "central scattering"),
        ("other", 0.05, "Very weak other shows positive", "with cos θ*"),
        ("other", float("nan"), "Very weak other shows negative", "with cos θ*"),
    ],
)
def test_interpretation(spark, feature, r, start, end):
    df = spark.createDataFrame([(feature, r)], ["f", "r"])
    text = df.select(interpret_correlation(F.col("f"), F.col("r"))).first()[0]
    assert text.startswith(start) and text.endswith(end)
