"""Selection, observables, array operators and engineered features."""

from __future__ import annotations

from pyspark.sql import functions as F

from jetloom.cuts import DEFAULT_CUTS, LOOSE_CUTS
from jetloom.functions import kinematics as K
from jetloom.functions.interpretation import interpret_correlation
from jetloom.operators import features as FE
from jetloom.operators import selection as S
from jetloom.operators.metrics import threshold_masks
from jetloom.operators.observables import add_boost_invariants, add_observables, self_pair_observables
from jetloom.schema import JET_FIELDS, OBSERVABLES, PAIR_COLUMNS
from workloads.base import (
    QUALITY,
    SQL_OBS,
    SQL_JETS,
    SQL_NESTED,
    SQL_PAIRS,
    jets,
    nested_events,
    observed,
    pairs,
    parallel_events,
    query,
    rounded,
    selected,
    sql_observed,
    sql_pairs_of,
    sql_round,
    sql_selected,
    table,
)

DY = "abs(leading_jet_eta - subleading_jet_eta)"


# ---------------------------------------------------------------- flagship


@query(
    "flagship_mass_spectrum",
    SQL_OBS
    + " SELECT CAST(floor(mjj / 100.0) AS BIGINT) AS mass_bin, count(*) AS n_events,"
    " round(avg(cos_theta_star), 6) AS mean_cos_theta_star FROM obs GROUP BY 1",
)
def flagship(spark, sf_dir):
    events = observed(spark, sf_dir)
    return rounded(
        events.groupBy(F.floor(F.col("mjj") / 100.0).alias("mass_bin")).agg(
            F.count(F.lit(1)).alias("n_events"), F.avg("cos_theta_star").alias("mean_cos_theta_star")
        )
    )


# ---------------------------------------------------------------- P: scalar physics


@query(
    "p1_mev_to_gev",
    f"WITH {SQL_NESTED} SELECT event_id, {sql_round([('pt', 'pt / 1000.0'), ('m', 'm / 1000.0')])}, "
    f"{sql_round(['eta', 'phi', 'jvt'])} FROM jets",
)
def p1(spark, sf_dir):
    events = nested_events(spark, sf_dir)
    scaled = events.select("event_id", S.jets_in_gev(F.col("jets")).alias("jets"))
    return rounded(scaled.select("event_id", F.inline("jets")))


def _observable_query(qid: str, name: str, digits: int = 6):
    oracle = SQL_OBS + f" SELECT event_id, round({name}, {digits}) AS {name} FROM obs"

    @query(f"{qid}_{name}", oracle)
    def run(spark, sf_dir):
        return rounded(observed(spark, sf_dir).select("event_id", name), digits)


_observable_query("p2", "mjj", 4)
_observable_query("p3", "delta_y")
_observable_query("p4", "delta_phi")
_observable_query("p5", "chi")
_observable_query("p6", "cos_theta_star")


@query(
    "p7_observable_set",
    SQL_OBS
    + " SELECT event_id, n_jets, round(mjj, 4) AS mjj, "
    + sql_round(OBSERVABLES[1:])
    + ", "
    + sql_round(PAIR_COLUMNS, 8)
    + " FROM obs",
)
def p7(spark, sf_dir):
    columns = ["event_id", "n_jets", *OBSERVABLES, *PAIR_COLUMNS]
    return rounded(observed(spark, sf_dir).select(*columns), {"mjj": 4, **{c: 8 for c in PAIR_COLUMNS}})


@query(
    "p8_self_paired_jets",
    f"WITH {SQL_NESTED} SELECT event_id, pos, round(2 * m, 6) AS mjj, 0.0::DOUBLE AS delta_y, "
    "0.0::DOUBLE AS delta_phi, 1.0::DOUBLE AS chi, 0.0::DOUBLE AS cos_theta_star, 1.0::DOUBLE AS pt_balance, "
    + sql_round([("dijet_pt", "2 * pt"), ("average_pt", "pt"), ("eta_centrality", "eta")])
    + " FROM jets",
)
def p8(spark, sf_dir):
    events = nested_events(spark, sf_dir)
    per_jet = events.select("event_id", F.posexplode(self_pair_observables(F.col("jets"))))
    flat = per_jet.select("event_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "col.*")
    return rounded(flat)


@query(
    "p9_boost_invariants",
    SQL_OBS
    + " SELECT event_id, "
    + sql_round(
        [("invariant_ht", "leading_jet_pt + subleading_jet_pt"), ("boost_weight", "exp(-0.5 * delta_y * delta_y)")]
    )
    + " FROM obs",
)
def p9(spark, sf_dir):
    out = add_boost_invariants(observed(spark, sf_dir))
    return rounded(out.select("event_id", "invariant_ht", "boost_weight"))


@query(
    "p10_cross_section_weight",
    SQL_OBS
    + " SELECT event_id, process, round(1e12 * CASE process WHEN 'qq' THEN 0.4 / pow(mjj, 4.3) "
    "WHEN 'qg' THEN 0.35 / pow(mjj, 4.4) WHEN 'gg' THEN 0.25 / pow(mjj, 4.6) ELSE 1.0 / pow(mjj, 4.5) END, 6) "
    "AS weight, round(1e12 / pow(mjj, 4.5), 6) AS inclusive_weight FROM (SELECT *, CASE n_jets WHEN 2 THEN 'qq' "
    "WHEN 3 THEN 'qg' WHEN 4 THEN 'gg' WHEN 5 THEN 'inclusive' ELSE 'other' END AS process FROM obs)",
)
def p10(spark, sf_dir):
    n = F.col("n_jets")
    process = F.when(n == 2, "qq").when(n == 3, "qg").when(n == 4, "gg").when(n == 5, "inclusive").otherwise("other")
    weighted = observed(spark, sf_dir).withColumn("process", process)
    return rounded(
        weighted.select(
            "event_id",
            "process",
            (K.cross_section_weight("mjj", F.col("process")) * 1e12).alias("weight"),
            (K.cross_section_weight("mjj") * 1e12).alias("inclusive_weight"),
        )
    )


@query(
    "p11_parton_correction",
    SQL_OBS
    + " SELECT event_id, round(cos_theta_star*(1+0.1*exp(-mjj/1000.0))*(1+0.05*cos_theta_star), 6) AS corrected FROM obs",
)
def p11(spark, sf_dir):
    corrected = K.parton_correction("cos_theta_star", "mjj")
    return rounded(observed(spark, sf_dir).select("event_id", corrected.alias("corrected")))


@query("p12_residual", SQL_PAIRS + " SELECT event_id, round(y_pred - y_true, 9) AS residual FROM pairs")
def p12(spark, sf_dir):
    return rounded(pairs(spark, sf_dir).select("event_id", K.residual("y_true", "y_pred").alias("residual")), 9)


@query(
    "p13_quality_status",
    SQL_PAIRS
    + " SELECT status, count(*) AS n FROM (SELECT CASE WHEN abs(y_pred - y_true) < 0.05 THEN 'green' "
    "WHEN abs(y_pred - y_true) < 0.1 THEN 'orange' ELSE 'red' END AS status FROM pairs) GROUP BY status",
)
def p13(spark, sf_dir):
    status = K.quality_status(F.abs(K.residual("y_true", "y_pred")))
    return pairs(spark, sf_dir).groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


_TEXT_SQL = """CASE WHEN abs(r) > 0.5 THEN 'Strong' WHEN abs(r) > 0.3 THEN 'Moderate'
  WHEN abs(r) > 0.1 THEN 'Weak' ELSE 'Very weak' END || ' ' ||
  CASE feature
  WHEN 'delta_y' THEN 'Rapidity separation shows ' || sgn || ' correlation with cos θ*. ' || CASE WHEN r < 0
    THEN 'Higher Δy typically means more central scattering (lower cos θ*)'
    ELSE 'Unexpected positive correlation with cos θ*' END
  WHEN 'chi' THEN 'Chi variable (e^|Δy|) shows ' || sgn || ' correlation. ' || CASE WHEN r < 0
    THEN 'Expected: higher χ means lower cos θ* (more central scattering)'
    ELSE 'Unexpected: higher χ correlates with higher cos θ*' END
  WHEN 'mjj' THEN 'Dijet mass shows ' || sgn || ' correlation. Physics: ' || CASE WHEN r > 0
    THEN 'Higher masses may favor more forward scattering'
    ELSE 'Higher masses correlate with more central scattering' END
  WHEN 'pt_balance' THEN 'pT balance shows ' || sgn || ' correlation. ' || CASE WHEN r > 0
    THEN 'Balanced events tend toward forward scattering'
    ELSE 'Balanced events tend toward central scattering' END
  WHEN 'eta_centrality' THEN 'Eta centrality shows ' || sgn || ' correlation. ' || CASE WHEN r < 0
    THEN 'More central events (low |η|) favor forward scattering'
    ELSE 'Forward events have higher average |η|' END
  ELSE feature || ' shows ' || sgn || ' correlation with cos θ*' END"""

_NAMED = ("delta_y", "chi", "mjj", "pt_balance", "eta_centrality", "delta_phi")


@query(
    "p14_interpretation_text",
    SQL_OBS
    + ", signed AS (SELECT event_id, feature, r, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS sgn FROM ("
    + " UNION ALL ".join(f"SELECT event_id, '{f}' AS feature, eta_centrality / 4.0 AS r FROM obs" for f in _NAMED)
    + f")) SELECT event_id, feature, {_TEXT_SQL} AS txt FROM signed",
)
def p14(spark, sf_dir):
    names = F.explode(F.array(*[F.lit(f) for f in _NAMED])).alias("feature")
    rows = observed(spark, sf_dir).select("event_id", (F.col("eta_centrality") / 4.0).alias("r"), names)
    return rows.select("event_id", "feature", interpret_correlation(F.col("feature"), F.col("r")).alias("txt"))


# ---------------------------------------------------------------- E: features

_FEATURE_SQL = {
    "e1": {"log_mjj": "ln(mjj)"},
    "e2": {"log_chi": "ln(chi)"},
    "e3": {"sqrt_pt_balance": "sqrt(pt_balance)"},
    "e4": {"pt_balance_squared": "pt_balance * pt_balance"},
    "e5": {"eta_centrality": "(leading_jet_eta + subleading_jet_eta) / 2"},
    "e6": {"eta_asymmetry": f"{DY} / 2"},
    "e7": {"geometric_mean_pt": "sqrt(leading_jet_pt * subleading_jet_pt)"},
    "e8": {"harmonic_mean_pt": "2 / (1 / leading_jet_pt + 1 / subleading_jet_pt)"},
    "e9": {"pt_ratio": "leading_jet_pt / subleading_jet_pt"},
    "e10": {"mjj_over_pt_sum": "mjj / (leading_jet_pt + subleading_jet_pt)"},
    "e11": {"angular_product": "delta_y * delta_phi"},
    "e12": {"angular_ratio": "delta_y / (delta_phi + 1e-6)"},
    "e13": {"delta_y_squared": "delta_y * delta_y", "delta_y_cubed": "delta_y * delta_y * delta_y"},
    "e14": {"boost_invariant": "delta_y / (1 + abs(eta_centrality))"},
}


def _feature_query(qid: str, definitions: dict[str, str]):
    names = list(definitions)
    # Dividing by a separation near zero magnifies the last digit: four places there.
    digits = 4 if qid == "e12" else 6
    oracle = SQL_OBS + f" SELECT event_id, {sql_round(list(definitions.items()), digits)} FROM obs"

    @query(f"{qid}_{names[0]}", oracle)
    def run(spark, sf_dir):
        return rounded(FE.add_features(observed(spark, sf_dir)).select("event_id", *names), digits)


for _qid, _definitions in _FEATURE_SQL.items():
    _feature_query(_qid, _definitions)


@query(
    "e15_conditional_features",
    SQL_OBS
    + " SELECT event_id, round(mjj, 4) AS mjj, "
    + sql_round(["delta_y", ("log_mjj", "ln(mjj)"), ("delta_y_squared", "delta_y * delta_y")])
    + ", round(delta_y * delta_y * delta_y, 6) AS delta_y_cubed FROM obs",
)
def e15(spark, sf_dir):
    narrow = observed(spark, sf_dir).select("event_id", "mjj", "delta_y")
    return rounded(FE.add_features(narrow), {"mjj": 4})


ALL_FEATURES = [
    "n_jets",
    *PAIR_COLUMNS,
    *[o for o in OBSERVABLES if o != "cos_theta_star"],
    *[n for d in _FEATURE_SQL.values() for n in d if n != "eta_centrality"],
]
SQL_FEATURES = (
    SQL_OBS
    + ",\nfeat AS (SELECT *, "
    + ", ".join(f"{e} AS {n}" for d in _FEATURE_SQL.values() for n, e in d.items() if n != "eta_centrality")
    + " FROM obs)"
)


@query(
    "e16_feature_columns",
    SQL_FEATURES + " " + " UNION ALL ".join(f"SELECT '{f}' AS feature, count({f}) AS n_values FROM feat" for f in ALL_FEATURES),
)
def e16(spark, sf_dir):
    features = FE.add_features(observed(spark, sf_dir))
    names = FE.feature_columns(features)
    counted = features.agg(*[F.count(c).alias(c) for c in names])
    return counted.unpivot([], names, "feature", "n_values")


# ---------------------------------------------------------------- F: cuts


@query(
    "f1_jet_quality",
    f"WITH {SQL_NESTED}, gev AS (SELECT event_id, pt / 1000.0 AS pt, eta, phi, m / 1000.0 AS m, jvt FROM jets) "
    f"SELECT event_id, {sql_round(JET_FIELDS)} FROM gev WHERE {QUALITY}",
)
def f1(spark, sf_dir):
    events = nested_events(spark, sf_dir)
    good = S.good_jets(F.col("jets"), DEFAULT_CUTS)
    return rounded(events.select("event_id", F.inline(good)))


@query(
    "f2_enough_good_jets",
    f"WITH {SQL_NESTED},\n{sql_pairs_of()} SELECT event_id, n_jets FROM picked",
)
def f2(spark, sf_dir):
    return S.pick_pairs(nested_events(spark, sf_dir)).select("event_id", "n_jets")


@query(
    "f3_balance_cut",
    sql_selected(mass=None) + " SELECT event_id, round(subleading_jet_pt / leading_jet_pt, 6) AS pt_balance FROM selected",
)
def f3(spark, sf_dir):
    kept = selected(spark, sf_dir, DEFAULT_CUTS.with_(mjj_min=None))
    return rounded(kept.select("event_id", S.balance().alias("pt_balance")))


@query("f4_mass_cut", sql_selected() + " SELECT event_id, n_jets, round(mjj, 4) AS mjj FROM selected")
def f4(spark, sf_dir):
    return rounded(selected(spark, sf_dir).select("event_id", "n_jets", "mjj"), 4)


@query(
    "f5_loose_selection_raw_units",
    sql_observed(quality="pt > 50000", balance=None, mass=None).replace("pt / 1000.0", "pt").replace("m / 1000.0", "m")
    + " SELECT event_id, n_jets, round(mjj / 1000.0, 4) AS mjj_k, "
    + sql_round(["delta_y", "delta_phi", "chi", "cos_theta_star", "pt_balance"])
    + " FROM obs",
)
def f5(spark, sf_dir):
    # unit="GeV" leaves the values as they are, so the threshold acts on the raw numbers.
    cuts = LOOSE_CUTS.with_(pt_min=50_000.0)
    loose = add_observables(S.select_jets(jets(spark, sf_dir), cuts, unit="GeV"))
    loose = loose.withColumn("mjj_k", F.col("mjj") / 1000.0)
    names = ["delta_y", "delta_phi", "chi", "cos_theta_star", "pt_balance"]
    return rounded(loose.select("event_id", "n_jets", "mjj_k", *names), {"mjj_k": 4})


@query(
    "f6_custom_thresholds",
    sql_selected(
        quality="pt > 80 AND abs(eta) < 2.4 AND (abs(eta) > 2.0 OR jvt > 0.2)", balance=0.5, mass=400.0
    )
    + " SELECT event_id, n_jets, round(mjj, 4) AS mjj FROM selected WHERE n_jets >= 3",
)
def f6(spark, sf_dir):
    cuts = DEFAULT_CUTS.with_(
        min_jets=3, pt_min=80.0, abs_eta_max=2.4, jvt_abs_eta=2.0, jvt_min=0.2, pt_balance_min=0.5, mjj_min=400.0
    )
    return rounded(selected(spark, sf_dir, cuts).select("event_id", "n_jets", "mjj"), 4)


@query(
    "f7_rapidity_separation_cut",
    sql_selected() + f" SELECT event_id, round({DY}, 6) AS delta_y FROM selected WHERE {DY} <= 2.0",
)
def f7(spark, sf_dir):
    kept = selected(spark, sf_dir, DEFAULT_CUTS.with_(delta_y_max=2.0))
    return rounded(kept.select("event_id", K.delta_y("leading_jet_eta", "subleading_jet_eta").alias("delta_y")))


def _flow_sql(source: str) -> str:
    return (
        sql_selected(source=source)
        + ", flags AS (SELECT subleading_jet_pt / leading_jet_pt >= 0.3 AS bal, mjj >= 200 AS heavy FROM massed) "
        "SELECT (SELECT count(DISTINCT event_id) FROM jets) AS n_input, count(*) AS n_jets_ok, "
        "count(*) FILTER (WHERE bal) AS n_balance_ok, count(*) FILTER (WHERE bal AND heavy) AS n_mass_ok, "
        "round(count(*) FILTER (WHERE bal AND heavy)::DOUBLE / (SELECT count(DISTINCT event_id) FROM jets), 6) "
        "AS efficiency FROM flags"
    )


@query("f8_selection_efficiency", _flow_sql(SQL_JETS))
def f8(spark, sf_dir):
    return rounded(S.cut_flow_jets(jets(spark, sf_dir)))


@query("f8_selection_efficiency_arrays", _flow_sql(SQL_NESTED))
def f8_arrays(spark, sf_dir):
    return rounded(S.cut_flow_events(nested_events(spark, sf_dir)))


@query(
    "f9_numeric_columns",
    " UNION ALL ".join(
        f"SELECT '{c}' AS col, round(avg({c}), 4) AS mean_value FROM lineitem"
        for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ),
)
def f9(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    names = FE.numeric_columns(rows)
    means = rows.agg(*[F.avg(c).alias(c) for c in names])
    return rounded(means.unpivot([], names, "col", "mean_value"), 4)


@query(
    "f10_threshold_masks",
    SQL_OBS
    + " SELECT count(*) FILTER (WHERE cos_theta_star > 0.7) AS above_70, count(*) FILTER (WHERE cos_theta_star > 0.8) "
    "AS above_80, count(*) FILTER (WHERE cos_theta_star > 0.9) AS above_90, count(*) FILTER (WHERE mjj > 500) AS heavy, "
    "count(*) FILTER (WHERE cos_theta_star >= 0 AND cos_theta_star <= 1) AS in_bounds FROM obs",
)
def f10(spark, sf_dir):
    y = F.col("cos_theta_star")
    masks = {
        "above_70": y > 0.7,
        "above_80": y > 0.8,
        "above_90": y > 0.9,
        "heavy": F.col("mjj") > 500,
        "in_bounds": (y >= 0) & (y <= 1),
    }
    return threshold_masks(observed(spark, sf_dir), masks)


# ---------------------------------------------------------------- A: arrays and top-k


@query(
    "a1_leading_and_subleading_jet",
    f"WITH {SQL_NESTED},\n{sql_pairs_of()} SELECT event_id, {sql_round(PAIR_COLUMNS)} FROM picked",
)
def a1(spark, sf_dir):
    return rounded(S.pick_pairs(nested_events(spark, sf_dir)).select("event_id", *PAIR_COLUMNS))


@query(
    "a1_leading_and_subleading_rows",
    f"WITH {SQL_JETS},\n{sql_pairs_of()} SELECT event_id, {sql_round(PAIR_COLUMNS, 8)} FROM picked",
)
def a1_rows(spark, sf_dir):
    return rounded(S.pick_jet_pairs(jets(spark, sf_dir)).select("event_id", *PAIR_COLUMNS), 8)


@query(
    "a2_jet_count",
    f"WITH {SQL_NESTED}, gev AS (SELECT event_id, pt / 1000.0 AS pt, eta, jvt FROM jets) "
    f"SELECT event_id, count(*) FILTER (WHERE {QUALITY}) AS n_jets FROM gev GROUP BY event_id",
)
def a2(spark, sf_dir):
    events = nested_events(spark, sf_dir)
    return events.select("event_id", S.count_jets(S.good_jets(F.col("jets"))).alias("n_jets"))


@query(
    "a3_zip_filter_sort",
    f"WITH {SQL_NESTED} SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY pt DESC, eta DESC, phi DESC, "
    f"m DESC, jvt DESC) - 1 AS pos, {sql_round(JET_FIELDS)} FROM jets WHERE pt > 50000",
)
def a3(spark, sf_dir):
    zipped = S.zip_jets(parallel_events(spark, sf_dir))
    ranked = S.good_jets(F.col("jets"), LOOSE_CUTS.with_(pt_min=50_000.0), unit="GeV")
    flat = zipped.select("event_id", F.posexplode(ranked)).select("event_id", F.col("pos").cast("bigint").alias("pos"), "col.*")
    return rounded(flat)
