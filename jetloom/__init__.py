"""jetloom: two-jet collision-event analytics expressed as Spark DataFrame work."""

from jetloom.cuts import DEFAULT_CUTS, LOOSE_CUTS, SelectionCuts
from jetloom.session import local_session, stage, stage_path

__all__ = [
    "DEFAULT_CUTS",
    "LOOSE_CUTS",
    "SelectionCuts",
    "local_session",
    "stage",
    "stage_path",
]
