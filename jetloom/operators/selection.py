"""Jet quality, leading-pair picking and event cuts.

Two physical layouts give the same selected-event table:

* :func:`select_events` - one row per event with a jet array. Higher-order functions
  only: no shuffle, no Python.
* :func:`select_jets` - one row per jet. The best two jets of an event come from a
  ranked window whose limit Spark applies *before* the shuffle, and the jet count from a
  partially aggregated count, so an event id owning a large share of the table never
  lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jetloom.cuts import DEFAULT_CUTS, SelectionCuts
from jetloom.functions import kinematics as K
from jetloom.schema import JET_FIELDS, PAIR_FIELDS, PAIR_SIDES

_UNITS = {"MeV": True, "GeV": False}


def _needs_scaling(unit: str) -> bool:
    if unit not in _UNITS:
        raise ValueError(f"unit must be one of {sorted(_UNITS)}, not {unit!r}")
    return _UNITS[unit]


def quality(pt: Column, eta: Column, phi: Column, m: Column, jvt: Column, cuts: SelectionCuts) -> Column:
    """Jet quality predicate on GeV values.

    Every comparison is strict. NaN fails (Spark would rank it above any number), and a
    jet padded in from a shorter array (null momentum, angle or mass) fails too.
    """
    keep = (K.nan_low(pt) > F.lit(cuts.pt_min)) & eta.isNotNull() & phi.isNotNull() & m.isNotNull()
    if cuts.abs_eta_max is not None:
        keep = keep & (F.abs(eta) < F.lit(cuts.abs_eta_max))
    if cuts.jvt_min is not None:
        forward = K.nan_low(F.abs(eta)) > F.lit(cuts.jvt_abs_eta)
        keep = keep & (forward | (K.nan_low(jvt) > F.lit(cuts.jvt_min)))
    return F.coalesce(keep, F.lit(False))


# ---------------------------------------------------------------- array layout


def zip_jets(events: DataFrame) -> DataFrame:
    """Parallel arrays to one array of jet structs; short arrays pad with null."""
    zipped = F.arrays_zip(*[F.col(f) for f in JET_FIELDS])
    others = [c for c in events.columns if c not in JET_FIELDS]
    return events.select(*others, zipped.alias("jets"))


def jets_in_gev(jets: Column, unit: str = "MeV") -> Column:
    """Rescale momentum and mass of every jet to GeV."""
    if not _needs_scaling(unit):
        return jets
    return F.transform(
        jets,
        lambda j: F.struct(
            K.to_gev(j["pt"]).alias("pt"),
            j["eta"].alias("eta"),
            j["phi"].alias("phi"),
            K.to_gev(j["m"]).alias("m"),
            j["jvt"].alias("jvt"),
        ),
    )


def good_jets(jets: Column, cuts: SelectionCuts = DEFAULT_CUTS, unit: str = "MeV") -> Column:
    """The jets of an array that pass :func:`quality`, hardest first.

    The struct order (pt, eta, phi, m, jvt) makes the sort total, so ties are repeatable.
    """
    passing = F.filter(
        jets_in_gev(jets, unit), lambda j: quality(*[j[f] for f in JET_FIELDS], cuts)
    )
    return F.sort_array(passing, asc=False)


def count_jets(jets: Column) -> Column:
    """Array length as BIGINT."""
    return F.size(jets).cast("bigint")


def pick_pairs(
    events: DataFrame,
    cuts: SelectionCuts = DEFAULT_CUTS,
    unit: str = "MeV",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Events with enough good jets, flattened to their two hardest.

    ``keep`` names lineage columns to carry along.
    """
    ranked = good_jets(F.col("jets"), cuts, unit)
    # A generator over the zero-or-one qualifying arrays: the sorted array is evaluated
    # once per event instead of once per column and once more in the filter.
    qualifying = F.filter(F.array(ranked), lambda a: F.size(a) >= cuts.min_jets)
    sides = [
        F.get("_good", F.lit(i))[f].alias(f"{side}_jet_{f}")
        for i, side in enumerate(PAIR_SIDES)
        for f in PAIR_FIELDS
    ]
    flat = events.select("event_id", *keep, F.explode(qualifying).alias("_good"))
    return flat.select("event_id", *keep, count_jets(F.col("_good")).alias("n_jets"), *sides)


def select_events(
    events: DataFrame,
    cuts: SelectionCuts = DEFAULT_CUTS,
    unit: str = "MeV",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Full selection on the array layout."""
    return apply_event_cuts(pick_pairs(events, cuts, unit, keep), cuts)


# ---------------------------------------------------------------- jet-per-row layout


def _good_rows(jets: DataFrame, cuts: SelectionCuts, unit: str) -> DataFrame:
    scaled = jets.select("event_id", *JET_FIELDS)
    if _needs_scaling(unit):
        # Implied by the GeV cut below, but on the bare column, so it reaches the scan.
        scaled = scaled.where(F.col("pt") >= F.lit(cuts.pt_min * 1000.0))
        scaled = scaled.withColumns({f: K.to_gev(f) for f in ("pt", "m")})
    return scaled.where(quality(*[F.col(f) for f in JET_FIELDS], cuts))


def pick_jet_pairs(
    jets: DataFrame, cuts: SelectionCuts = DEFAULT_CUTS, unit: str = "MeV"
) -> DataFrame:
    """:func:`pick_pairs` for a table with one row per jet."""
    good = _good_rows(jets, cuts, unit)
    hardest = Window.partitionBy("event_id").orderBy(*[F.desc(f) for f in JET_FIELDS])
    top2 = good.withColumn("_rank", F.row_number().over(hardest)).where(F.col("_rank") <= 2)
    pairs = top2.groupBy("event_id").agg(
        *[
            F.max(F.when(F.col("_rank") == i, F.col(f))).alias(f"{side}_jet_{f}")
            for i, side in enumerate(PAIR_SIDES, start=1)
            for f in PAIR_FIELDS
        ]
    )
    pairs = pairs.where(F.col("subleading_jet_pt").isNotNull())
    counts = good.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_jets"))
    # Left join on a unique key: when n_jets is not asked for, Catalyst drops the join.
    out = pairs.join(counts, "event_id", "left")
    if cuts.min_jets > 2:
        out = out.where(F.col("n_jets") >= cuts.min_jets)
    sides = [c for c in pairs.columns if c != "event_id"]
    return out.select("event_id", "n_jets", *sides)


def select_jets(
    jets: DataFrame, cuts: SelectionCuts = DEFAULT_CUTS, unit: str = "MeV"
) -> DataFrame:
    """Full selection on the jet-per-row layout."""
    return apply_event_cuts(pick_jet_pairs(jets, cuts, unit), cuts)


# ---------------------------------------------------------------- event cuts


def balance() -> Column:
    """Subleading over leading transverse momentum."""
    return F.try_divide(F.col("subleading_jet_pt"), F.col("leading_jet_pt"))


def mass_of_pair() -> Column:
    """Invariant mass of the selected pair."""
    return K.pair_mass(*[tuple(f"{s}_jet_{f}" for f in PAIR_FIELDS) for s in PAIR_SIDES])


def _at_least(value: Column, threshold: float) -> Column:
    return K.nan_low(value) >= F.lit(threshold)


def apply_event_cuts(pairs: DataFrame, cuts: SelectionCuts = DEFAULT_CUTS) -> DataFrame:
    """Balance cut, then the invariant mass and its cut (both inclusive)."""
    out = pairs
    if cuts.pt_balance_min is not None:
        out = out.where(_at_least(balance(), cuts.pt_balance_min))
    out = out.withColumn("mjj", mass_of_pair())
    if cuts.mjj_min is not None:
        out = out.where(_at_least(F.col("mjj"), cuts.mjj_min))
    if cuts.delta_y_max is not None:
        separation = K.delta_y("leading_jet_eta", "subleading_jet_eta")
        out = out.where(separation <= F.lit(cuts.delta_y_max))
    return out


def _flow(per_event: DataFrame, cuts: SelectionCuts) -> DataFrame:
    """One-row cut flow from one row per input event (pair columns null if no pair)."""
    stages = {"n_jets_ok": F.coalesce(F.col("subleading_jet_pt").isNotNull(), F.lit(False))}
    if cuts.pt_balance_min is not None:
        stages["n_balance_ok"] = F.coalesce(_at_least(balance(), cuts.pt_balance_min), F.lit(False))
    if cuts.mjj_min is not None:
        stages["n_mass_ok"] = F.coalesce(_at_least(mass_of_pair(), cuts.mjj_min), F.lit(False))
    passed, counts = F.lit(True), []
    for name, ok in stages.items():
        passed = passed & ok
        counts.append(F.count_if(passed).alias(name))
    flow = per_event.agg(F.count(F.lit(1)).alias("n_input"), *counts)
    last = list(stages)[-1]
    efficiency = F.coalesce(F.try_divide(F.col(last), F.col("n_input")), F.lit(0.0))
    return flow.withColumn("efficiency", efficiency)


def cut_flow_events(
    events: DataFrame, cuts: SelectionCuts = DEFAULT_CUTS, unit: str = "MeV"
) -> DataFrame:
    """Events left after each cut and the overall efficiency (0 on empty input)."""
    ranked = good_jets(F.col("jets"), cuts, unit)
    shortened = F.explode(F.array(ranked)).alias("_good")
    enough = F.size("_good") >= cuts.min_jets
    per_event = events.select("event_id", shortened).select(
        *[
            F.when(enough, F.get("_good", F.lit(i))[f]).alias(f"{side}_jet_{f}")
            for i, side in enumerate(PAIR_SIDES)
            for f in PAIR_FIELDS
        ]
    )
    return _flow(per_event, cuts)


def cut_flow_jets(
    jets: DataFrame, cuts: SelectionCuts = DEFAULT_CUTS, unit: str = "MeV"
) -> DataFrame:
    """:func:`cut_flow_events` for the jet-per-row layout."""
    everyone = jets.select("event_id").distinct()
    return _flow(everyone.join(pick_jet_pairs(jets, cuts, unit), "event_id", "left"), cuts)
