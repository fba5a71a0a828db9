"""Engineered features; each is added only when its inputs are present."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jetloom.schema import NON_FEATURES, NUMERIC_TYPES, TARGET

# Deterministic functions of the target: leave them out for an honest fit.
TARGET_PROXIES = (
    "delta_y",
    "chi",
    "log_chi",
    "delta_y_squared",
    "delta_y_cubed",
    "eta_asymmetry",
    "angular_product",
    "angular_ratio",
    "boost_invariant",
)

# Features used when no engineered set was saved with a model.
BASIC_FEATURES = (
    "mjj",
    "delta_y",
    "chi",
    "pt_balance",
    "delta_phi",
    "leading_jet_pt",
    "subleading_jet_pt",
)


def _definitions() -> list[tuple[tuple[str, ...], dict[str, Column]]]:
    c = F.col
    eta1, eta2 = c("leading_jet_eta"), c("subleading_jet_eta")
    pt1, pt2 = c("leading_jet_pt"), c("subleading_jet_pt")
    dy = c("delta_y")
    return [
        (("mjj",), {"log_mjj": F.ln("mjj")}),
        (("chi",), {"log_chi": F.ln("chi")}),
        (
            ("pt_balance",),
            {
                "sqrt_pt_balance": F.sqrt("pt_balance"),
                "pt_balance_squared": c("pt_balance") * c("pt_balance"),
            },
        ),
        (
            ("leading_jet_eta", "subleading_jet_eta"),
            {
                "eta_centrality": (eta1 + eta2) / 2.0,
                "eta_asymmetry": F.abs(eta1 - eta2) / 2.0,
            },
        ),
        (
            ("leading_jet_pt", "subleading_jet_pt"),
            {
                "geometric_mean_pt": F.sqrt(pt1 * pt2),
                "harmonic_mean_pt": F.try_divide(
                    F.lit(2.0), F.try_divide(F.lit(1.0), pt1) + F.try_divide(F.lit(1.0), pt2)
                ),
                "pt_ratio": F.try_divide(pt1, pt2),
            },
        ),
        (
            ("mjj", "leading_jet_pt", "subleading_jet_pt"),
            {"mjj_over_pt_sum": F.try_divide(c("mjj"), pt1 + pt2)},
        ),
        (
            ("delta_y", "delta_phi"),
            {
                "angular_product": dy * c("delta_phi"),
                "angular_ratio": F.try_divide(dy, c("delta_phi") + F.lit(1e-6)),
            },
        ),
        (
            ("delta_y",),
            {"delta_y_squared": dy * dy, "delta_y_cubed": dy * dy * dy},
        ),
        (
            ("eta_centrality", "delta_y"),
            {"boost_invariant": dy / (1.0 + F.abs(c("eta_centrality")))},
        ),
    ]


def add_features(df: DataFrame) -> DataFrame:
    """All features whose inputs exist, as one or two projections."""
    present = set(df.columns)
    direct: dict[str, Column] = {}
    dependent: dict[str, Column] = {}
    for inputs, outputs in _definitions():
        if set(inputs) <= present:
            direct.update(outputs)
        elif set(inputs) <= present | set(direct):
            dependent.update(outputs)
    out = df.withColumns(direct) if direct else df
    return out.withColumns(dependent) if dependent else out


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the integer and floating columns, in order."""
    return [name for name, kind in df.dtypes if kind in NUMERIC_TYPES]


def feature_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns minus identifiers, lineage, the target and ``exclude``."""
    dropped = {*NON_FEATURES, TARGET, *exclude}
    return [name for name in numeric_columns(df) if name not in dropped]
