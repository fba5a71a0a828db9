"""Physics of a jet pair as column expressions (all JVM-side, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cross-section weight = scale / mjj ** power, per process.
CROSS_SECTION = {
    "inclusive": (1.0, 4.5),
    "qq": (0.4, 4.3),
    "qg": (0.35, 4.4),
    "gg": (0.25, 4.6),
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_low(value: Column | str) -> Column:
    """NaN as minus infinity, so that it fails ``>`` and ``>=`` (Spark ranks it highest)."""
    return F.nanvl(_col(value), F.lit(float("-inf")))


def to_gev(mev: Column | str) -> Column:
    """MeV to GeV."""
    return _col(mev) / F.lit(1000.0)


def pair_mass(jet1: tuple, jet2: tuple) -> Column:
    """Invariant mass of two ``(pt, eta, phi, m)`` four-vectors, floored at zero.

    Expanded form m1^2 + m2^2 + 2 (E1 E2 - p1.p2): each input enters every function once,
    so the expression stays small where Catalyst copies it into a filter, and light pairs
    keep their digits.
    """
    (pt1, eta1, phi1, m1), (pt2, eta2, phi2, m2) = (tuple(map(_col, j)) for j in (jet1, jet2))
    energies = F.hypot(pt1 * F.cosh(eta1), m1) * F.hypot(pt2 * F.cosh(eta2), m2)
    opening = F.cos(phi1 - phi2) + F.sinh(eta1) * F.sinh(eta2)
    squared = m1 * m1 + m2 * m2 + F.lit(2.0) * (energies - pt1 * pt2 * opening)
    return F.sqrt(F.greatest(squared, F.lit(0.0)))


def delta_y(eta1: Column | str, eta2: Column | str) -> Column:
    """Rapidity separation."""
    return F.abs(_col(eta1) - _col(eta2))


def delta_phi(phi1: Column | str, phi2: Column | str) -> Column:
    """Azimuthal separation wrapped into [0, pi]."""
    d = _col(phi1) - _col(phi2)
    return F.abs(F.atan2(F.sin(d), F.cos(d)))


def chi(dy: Column | str) -> Column:
    """exp of the rapidity separation."""
    return F.exp(_col(dy))


def cos_theta_star(chi_: Column | str) -> Column:
    """Scattering-angle cosine from chi."""
    c = _col(chi_)
    return (c - 1) / (c + 1)


def boost_weight(dy: Column | str) -> Column:
    """Gaussian weight in the rapidity separation."""
    return F.exp(F.lit(-0.5) * _col(dy) * _col(dy))


def cross_section_weight(mjj: Column | str, process: Column | str = "inclusive") -> Column:
    """Falling-spectrum weight; ``process`` is a name or a per-row column.

    Unknown processes weigh like the inclusive one.
    """
    mass = _col(mjj)

    def falling(name: str) -> Column:
        scale, power = CROSS_SECTION[name]
        return F.try_divide(F.lit(scale), F.pow(mass, F.lit(power)))

    if isinstance(process, str):
        return falling(process if process in CROSS_SECTION else "inclusive")
    picked = F.lit(None).cast("double")
    for name in CROSS_SECTION:
        if name != "inclusive":
            picked = F.when(process == name, falling(name)).otherwise(picked)
    return F.coalesce(picked, falling("inclusive"))


def parton_correction(cos_theta: Column | str, mjj: Column | str) -> Column:
    """Hadronisation and detector correction of the scattering cosine."""
    c = _col(cos_theta)
    energy = 1 + F.lit(0.1) * F.exp(-_col(mjj) / 1000.0)
    return c * energy * (1 + F.lit(0.05) * c)


def residual(y_true: Column | str, y_pred: Column | str) -> Column:
    """Prediction minus truth."""
    return _col(y_pred) - _col(y_true)


def quality_status(value: Column | str) -> Column:
    """Traffic light of a consistency metric: below 0.05 green, below 0.1 orange."""
    v = _col(value)
    return F.when(v < 0.05, "green").when(v < 0.1, "orange").otherwise("red")
