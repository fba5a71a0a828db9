"""Observables of the selected pair, and the degenerate per-jet variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jetloom.functions import kinematics as K
from jetloom.operators.selection import balance, mass_of_pair


def add_observables(pairs: DataFrame) -> DataFrame:
    """Mass, angular and balance observables as extra columns."""
    pt = [F.col(f"{s}_jet_pt") for s in ("leading", "subleading")]
    eta = [F.col(f"{s}_jet_eta") for s in ("leading", "subleading")]
    phi = [F.col(f"{s}_jet_phi") for s in ("leading", "subleading")]
    separation = K.delta_y(*eta)
    columns: dict[str, Column] = {
        "delta_y": separation,
        "delta_phi": K.delta_phi(*phi),
        "chi": K.chi(separation),
        "cos_theta_star": K.cos_theta_star(K.chi(separation)),
        "pt_balance": balance(),
        "dijet_pt": pt[0] + pt[1],
        "average_pt": (pt[0] + pt[1]) / 2.0,
        "eta_centrality": (eta[0] + eta[1]) / 2.0,
    }
    if "mjj" not in pairs.columns:
        columns = {"mjj": mass_of_pair(), **columns}
    return pairs.withColumns(columns)


def self_pair_observables(jets: Column) -> Column:
    """Per-jet array of observables with each jet paired with itself.

    Degenerate by definition (no separation, balance 1, mass 2m); kept because the raw
    array interface computes exactly this. The mass is taken as 2m, which the difference of
    squared energy and momentum only reaches with few digits; without pt, eta or phi it is NULL.
    """

    def one(j: Column) -> Column:
        known = j["pt"].isNotNull() & j["eta"].isNotNull() & j["phi"].isNotNull()
        gap = K.delta_y(j["eta"], j["eta"])
        return F.struct(
            F.when(known, F.abs(j["m"]) * 2.0).alias("mjj"),
            gap.alias("delta_y"),
            K.delta_phi(j["phi"], j["phi"]).alias("delta_phi"),
            K.chi(gap).alias("chi"),
            K.cos_theta_star(K.chi(gap)).alias("cos_theta_star"),
            F.try_divide(j["pt"], j["pt"]).alias("pt_balance"),
            (j["pt"] + j["pt"]).alias("dijet_pt"),
            ((j["pt"] + j["pt"]) / 2.0).alias("average_pt"),
            ((j["eta"] + j["eta"]) / 2.0).alias("eta_centrality"),
        )

    return F.transform(jets, one)


def add_boost_invariants(df: DataFrame) -> DataFrame:
    """Scalar transverse sum and boost weight, when their inputs exist."""
    if not {"leading_jet_pt", "subleading_jet_pt", "delta_y"} <= set(df.columns):
        return df
    return df.withColumns(
        {
            "invariant_ht": F.col("leading_jet_pt") + F.col("subleading_jet_pt"),
            "boost_weight": K.boost_weight("delta_y"),
        }
    )
