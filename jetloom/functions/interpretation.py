"""Plain-language reading of a feature's correlation with cos(theta*)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (opening, text when the branch condition holds, text otherwise, branch).
# "neg" branches on r < 0, "pos" on r > 0. {sign} is filled per row.
SENTENCES = {
    "delta_y": (
        "Rapidity separation shows {sign} correlation with cos θ*. ",
        "Higher Δy typically means more central scattering (lower cos θ*)",
        "Unexpected positive correlation with cos θ*",
        "neg",
    ),
    "chi": (
        "Chi variable (e^|Δy|) shows {sign} correlation. ",
        "Expected: higher χ means lower cos θ* (more central scattering)",
        "Unexpected: higher χ correlates with higher cos θ*",
        "neg",
    ),
    "mjj": (
        "Dijet mass shows {sign} correlation. Physics: ",
        "Higher masses may favor more forward scattering",
        "Higher masses correlate with more central scattering",
        "pos",
    ),
    "pt_balance": (
        "pT balance shows {sign} correlation. ",
        "Balanced events tend toward forward scattering",
        "Balanced events tend toward central scattering",
        "pos",
    ),
    "eta_centrality": (
        "Eta centrality shows {sign} correlation. ",
        "More central events (low |η|) favor forward scattering",
        "Forward events have higher average |η|",
        "neg",
    ),
}
FALLBACK = "{feature} shows {sign} correlation with cos θ*"
STRENGTHS = ((0.5, "Strong"), (0.3, "Moderate"), (0.1, "Weak"))
WEAKEST = "Very weak"


def _number(r: Column) -> Column:
    # NaN sorts above every number in Spark but fails every comparison in the data model.
    return F.nanvl(r, F.lit(None).cast("double"))


def strength(r: Column) -> Column:
    """Strength word for a correlation coefficient."""
    size = F.abs(_number(r))
    word = F.lit(WEAKEST)
    for threshold, name in reversed(STRENGTHS):
        word = F.when(size > threshold, name).otherwise(word)
    return word


def interpret_correlation(feature: Column, r: Column) -> Column:
    """``"<strength> <sentence>"`` for each (feature, correlation) row."""
    r = _number(r)
    sign = F.when(r > 0, "positive").otherwise("negative")

    def fill(template: str) -> Column:
        parts: list[Column] = []
        for i, piece in enumerate(template.split("{sign}")):
            if i:
                parts.append(sign)
            if piece.startswith("{feature}"):
                parts.append(feature)
                piece = piece.removeprefix("{feature}")
            parts.append(F.lit(piece))
        return F.concat(*parts)

    text = fill(FALLBACK)
    for name, (opening, holds, otherwise, branch) in SENTENCES.items():
        test = r < 0 if branch == "neg" else r > 0
        sentence = F.concat(fill(opening), F.when(test, holds).otherwise(otherwise))
        text = F.when(feature == name, sentence).otherwise(text)
    return F.concat(strength(r), F.lit(" "), text)
