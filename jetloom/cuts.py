"""Selection thresholds, passed explicitly to every transform that applies a cut."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class SelectionCuts:
    """Jet and event thresholds in GeV; ``None`` switches a cut off.

    The defaults are fixed values of the standard two-jet selection.
    """

    min_jets: int = 2
    pt_min: float = 50.0
    abs_eta_max: float | None = 4.5
    jvt_min: float | None = 0.5
    jvt_abs_eta: float = 2.5
    pt_balance_min: float | None = 0.3
    mjj_min: float | None = 200.0
    delta_y_max: float | None = None

    def __post_init__(self) -> None:
        if self.min_jets < 2:
            raise ValueError("min_jets must be at least 2: a pair needs two jets")

    def with_(self, **changes) -> "SelectionCuts":
        """Same cuts with some thresholds replaced."""
        return replace(self, **changes)


DEFAULT_CUTS = SelectionCuts()

# Only the transverse-momentum threshold and the jet count.
LOOSE_CUTS = SelectionCuts(
    abs_eta_max=None, jvt_min=None, pt_balance_min=None, mjj_min=None
)
