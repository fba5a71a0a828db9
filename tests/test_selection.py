"""Hand-made edge events, layout agreement and plan shape of the selection."""

import math

import pytest
from pyspark.sql import functions as F

from jetloom import DEFAULT_CUTS, LOOSE_CUTS
from jetloom.operators import selection as S
from jetloom.operators.observables import add_observables
from jetloom.schema import EVENT, FLAT_JET, PARALLEL_EVENT
from workloads import base as B

NAN = float("nan")
OPEN = DEFAULT_CUTS.with_(pt_balance_min=None, mjj_min=None)


def jet(pt, eta=0.0, phi=0.0, m=0.0, jvt=1.0):
    """A jet in GeV."""
    return (pt, eta, phi, m, jvt)


def events(spark, *rows):
    return spark.createDataFrame(list(rows), EVENT)


def flat(spark, *rows):
    return spark.createDataFrame([(i, *j) for i, js in rows for j in (js or [])], FLAT_JET)


def kept_ids(df):
    return sorted(r["event_id"] for r in df.select("event_id").collect())


EDGES = [
    (1, []),
    (2, None),
    (3, [jet(90.0)]),
    (4, [jet(90.0), jet(90.0)]),
    (5, [jet(90.0), jet(50.0)]),  # exactly at threshold fails
    (6, [jet(90.0), jet(80.0, eta=2.5, jvt=0.1)]),  # |eta| = 2.5 is still central
    (7, [jet(90.0), jet(80.0, eta=4.5)]),  # strict edge
    (8, [jet(90.0), jet(80.0, eta=-3.0, jvt=0.0)]),  # forward: jvt not asked
    (9, [jet(90.0), jet(80.0, eta=1.0, jvt=0.5)]),  # jvt strict
    (10, [jet(90.0), jet(80.0, jvt=NAN)]),
    (11, [jet(90.0), jet(None)]),
    (12, [jet(90.0), jet(NAN)]),
    (13, [jet(90.0), jet(80.0, phi=None)]),
    (14, [jet(90.0), jet(80.0, eta=NAN)]),
    (15, [jet(90.0), jet(80.0, eta=3.0, jvt=None)]),
    (16, [jet(90.0), jet(80.0, m=None)]),
]


def test_jet_quality_edges_in_both_layouts(spark):
    expected = [4, 8, 15]
    assert kept_ids(S.select_events(events(spark, *EDGES), OPEN, unit="GeV")) == expected
    assert kept_ids(S.select_jets(flat(spark, *EDGES), OPEN, unit="GeV")) == expected


def test_balance_is_inclusive(spark):
    rows = [(1, [jet(1000.0), jet(300.0)]), (2, [jet(1000.0), jet(299.9)])]
    cuts = DEFAULT_CUTS.with_(mjj_min=None)
    assert kept_ids(S.select_events(events(spark, *rows), cuts, unit="GeV")) == [1]
    assert kept_ids(S.select_jets(flat(spark, *rows), cuts, unit="GeV")) == [1]


def test_mass_is_inclusive_and_nan_fails(spark):
    # Massless back-to-back jets at eta 0: mass = pt1 + pt2.
    rows = [
        (1, [jet(100.0), jet(100.0, phi=math.pi)]),
        (2, [jet(99.9), jet(99.9, phi=math.pi)]),
        (3, [jet(100.0), jet(100.0, phi=NAN)]),
    ]
    assert kept_ids(S.select_events(events(spark, *rows), unit="GeV")) == [1]
    assert kept_ids(S.select_jets(flat(spark, *rows), unit="GeV")) == [1]


def test_units(spark):
    rows = [(1, [jet(120_000.0), jet(110_000.0, phi=3.0)])]
    out = S.select_events(events(spark, *rows)).first()
    assert out["leading_jet_pt"] == 120.0 and out["n_jets"] == 2
    raw = S.pick_pairs(events(spark, (1, [jet(60.0), jet(40.0), jet(55.0)])), LOOSE_CUTS, unit="GeV").first()
    assert (raw["leading_jet_pt"], raw["subleading_jet_pt"], raw["n_jets"]) == (60.0, 55.0, 2)
    with pytest.raises(ValueError):
        S.select_events(events(spark, *rows), unit="TeV")


def test_ties_break_by_all_fields(spark):
    js = [jet(80.0, eta=1.0, phi=0.5), jet(80.0, eta=1.0, phi=0.7), jet(80.0, eta=0.0)]
    for out in (
        S.pick_pairs(events(spark, (1, js)), LOOSE_CUTS, "GeV").first(),
        S.pick_jet_pairs(flat(spark, (1, js)), LOOSE_CUTS, "GeV").first(),
    ):
        assert (out["leading_jet_phi"], out["subleading_jet_phi"], out["n_jets"]) == (0.7, 0.5, 3)


def test_parallel_arrays_of_unequal_length(spark):
    rows = [(1, [90.0, 80.0, 70.0], [0.0, 1.0, 2.0], [0.0, 3.0], [1.0, 1.0, 1.0], [1.0, 1.0, 1.0])]
    zipped = S.zip_jets(spark.createDataFrame(rows, PARALLEL_EVENT))
    assert zipped.select(F.size("jets")).first()[0] == 3
    assert S.pick_pairs(zipped, LOOSE_CUTS, "GeV").first()["n_jets"] == 2


def test_minimum_jets(spark):
    rows = [(1, [jet(90.0)] * 3), (2, [jet(90.0)] * 2)]
    cuts = OPEN.with_(min_jets=3)
    assert kept_ids(S.select_events(events(spark, *rows), cuts, "GeV")) == [1]
    assert kept_ids(S.select_jets(flat(spark, *rows), cuts, "GeV")) == [1]
    with pytest.raises(ValueError):
        DEFAULT_CUTS.with_(min_jets=1)


def test_cut_flow_and_empty_input(spark):
    rows = [
        (1, [jet(200.0), jet(180.0, phi=3.0)]),
        (2, [jet(200.0)]),
        (3, [jet(900.0), jet(60.0, phi=3.0)]),
        (4, [jet(60.0), jet(60.0, phi=0.1)]),
    ]
    for flow in (
        S.cut_flow_events(events(spark, *rows), unit="GeV").first(),
        S.cut_flow_jets(flat(spark, *rows), unit="GeV").first(),
    ):
        assert flow.asDict() == {
            "n_input": 4, "n_jets_ok": 3, "n_balance_ok": 2, "n_mass_ok": 1, "efficiency": 0.25,
        }
    empty = S.cut_flow_events(events(spark).limit(0), unit="GeV").first()
    assert empty["n_input"] == 0 and empty["efficiency"] == 0.0
    assert S.select_events(spark.createDataFrame([], EVENT)).count() == 0
    assert S.select_jets(spark.createDataFrame([], FLAT_JET)).count() == 0


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_layouts_agree_under_any_partitioning(spark, sf_dir, partitions):
    jets = B.jets(spark, sf_dir)
    nested = jets.groupBy("event_id").agg(F.collect_list(F.struct("pt", "eta", "phi", "m", "jvt")).alias("jets"))
    a = add_observables(S.select_events(nested.repartition(partitions)))
    b = add_observables(S.select_jets(jets.repartition(partitions)))
    columns = sorted(a.columns)
    assert sorted(map(tuple, a.select(columns).collect())) == sorted(map(tuple, b.select(columns).collect()))


def test_hot_event_is_cut_before_the_shuffle(spark):
    # One event owns a third of all jets.
    hot = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("event_id"),
        (F.rand(3) * 900 + 60).alias("pt"),
        F.lit(0.5).alias("eta"),
        F.rand(4).alias("phi"),
        F.lit(1.0).alias("m"),
        F.lit(1.0).alias("jvt"),
    ).repartition(6)
    picked = S.pick_jet_pairs(hot, LOOSE_CUTS, "GeV")
    row = picked.where(F.col("event_id") == 1).first()
    mine = sorted((r["pt"] for r in hot.where(F.col("event_id") == 1).collect()), reverse=True)
    assert row["n_jets"] == len(mine)
    assert [row["leading_jet_pt"], row["subleading_jet_pt"]] == mine[:2]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf_dir):
    arrays = plan(add_observables(S.select_events(B.nested_events(spark, sf_dir))))
    assert "Exchange" not in arrays and "Python" not in arrays and arrays.count("sort_array") == 1
    rows = plan(add_observables(S.select_jets(B.jets(spark, sf_dir))).drop("n_jets"))
    assert "WindowGroupLimit" in rows and "Partial" in rows and "Python" not in rows
    assert rows.count("Exchange") == 1 and "Join" not in rows
    assert "SinglePartition" not in rows


def test_raw_threshold_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "jets")
    flat(spark, (1, [jet(90_000.0), jet(10.0)])).write.parquet(path)
    assert "GreaterThanOrEqual(pt,50000.0)" in plan(S.select_jets(spark.read.schema(FLAT_JET).parquet(path)))
