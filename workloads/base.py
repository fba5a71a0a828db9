"""Event tables derived from the driver's tables, in Spark and in SQL.

One order plays one collision and its line items play jets (jet-per-row layout); one
embedding row plays one collision whose components are laid out as parallel jet arrays
(array layout). Both derivations are narrow.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jetloom.cuts import DEFAULT_CUTS, SelectionCuts
from jetloom.functions import kinematics as K
from jetloom.operators.observables import add_observables
from jetloom.operators.selection import pick_jet_pairs, select_jets, zip_jets
from jetloom.operators.splits import FOLD, MULTIPLIER, PRIME, SEED

# 64 components in five blocks of 13: the last block is one short, so the last jet has no jvt.
JETS_PER_EMBEDDING = 13


@dataclass(frozen=True)
class Workload:
    """A registered query and, when SQL can express it, its oracle."""

    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None


REGISTRY: dict[str, Workload] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``."""

    def register(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Workload(fn, oracle)
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- Spark side


def jets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One jet per line item, momentum and mass in MeV."""
    phi_steps = (F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729) % 6283
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("event_id"),
        (F.col("l_extendedprice") * 10.0).alias("pt"),
        ((F.col("l_quantity") - 25.5) / 6.0).alias("eta"),
        (phi_steps.cast("double") / 1000.0 - 3.1415).alias("phi"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("m"),
        (F.col("l_tax") / 0.08).alias("jvt"),
    )


def parallel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per embedding row, its components read as five jet arrays (MeV)."""
    def block(i: int, fn):
        part = F.slice("embedding", i * JETS_PER_EMBEDDING + 1, JETS_PER_EMBEDDING)
        return F.transform(part, lambda v: fn(v.cast("double")))

    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("event_id"),
        block(0, lambda v: F.abs(v) * 1e6).alias("pt"),
        block(1, lambda v: v * 20.0).alias("eta"),
        block(2, lambda v: v * 8.0).alias("phi"),
        block(3, lambda v: F.abs(v) * 1e5).alias("m"),
        block(4, lambda v: F.abs(v) * 4.0).alias("jvt"),
    )


def nested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zip_jets(parallel_events(spark, sf_dir))


def selected(spark: SparkSession, sf_dir: str, cuts: SelectionCuts = DEFAULT_CUTS) -> DataFrame:
    return select_jets(jets(spark, sf_dir), cuts)


def observed(spark: SparkSession, sf_dir: str, cuts: SelectionCuts = DEFAULT_CUTS) -> DataFrame:
    return add_observables(selected(spark, sf_dir, cuts))


NO_CUTS = SelectionCuts(
    pt_min=0.0, abs_eta_max=None, jvt_min=None, pt_balance_min=None, mjj_min=None
)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, y_true, y_pred) without jet cuts: heavy ties, some predictions above 1.

    Nine decimals, so that equal separations are equal numbers under any exp().
    """
    seen = add_observables(pick_jet_pairs(jets(spark, sf_dir), NO_CUTS))
    return seen.select(
        "event_id",
        F.round("cos_theta_star", 9).alias("y_true"),
        F.round(K.parton_correction("cos_theta_star", "mjj"), 9).alias("y_pred"),
    )


# ---------------------------------------------------------------- SQL side

SQL_JETS = """jets AS (
  SELECT l_orderkey AS event_id, l_extendedprice * 10.0 AS pt, (l_quantity - 25.5) / 6.0 AS eta,
    CAST((l_partkey*7919 + l_suppkey*104729) % 6283 AS DOUBLE)/1000.0 - 3.1415 AS phi,
    l_extendedprice * l_discount AS m, l_tax / 0.08 AS jvt
  FROM lineitem)"""

SQL_NESTED = f"""wide AS (
  SELECT vec_id AS event_id, i AS pos, embedding AS v
  FROM embeddings, range(1, {JETS_PER_EMBEDDING + 1}) AS r(i)),
jets AS (
  SELECT event_id, pos, abs(CAST(v[pos] AS DOUBLE)) * 1e6 AS pt,
    CAST(v[pos + {JETS_PER_EMBEDDING}] AS DOUBLE) * 20.0 AS eta, CAST(v[pos + {2 * JETS_PER_EMBEDDING}] AS DOUBLE) * 8.0 AS phi,
    abs(CAST(v[pos + {3 * JETS_PER_EMBEDDING}] AS DOUBLE)) * 1e5 AS m, abs(CAST(v[pos + {4 * JETS_PER_EMBEDDING}] AS DOUBLE)) * 4.0 AS jvt
  FROM wide)"""

QUALITY = "pt > 50 AND abs(eta) < 4.5 AND (abs(eta) > 2.5 OR jvt > 0.5)"

_ANY = "event_id IS NOT NULL"


def sql_pairs_of(quality: str = QUALITY, scale: float = 1000.0) -> str:
    """CTEs good, ranked and picked on top of ``jets``."""
    sides = ", ".join(
        f"max(CASE WHEN rn = {i} THEN {f} END) AS {s}_jet_{f}"
        for i, s in ((1, "leading"), (2, "subleading"))
        for f in ("pt", "eta", "phi", "m")
    )
    return f"""gev AS (SELECT event_id, pt / {scale} AS pt, eta, phi, m / {scale} AS m, jvt FROM jets),
good AS (SELECT * FROM gev WHERE {quality}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY event_id
    ORDER BY pt DESC, eta DESC, phi DESC, m DESC, jvt DESC) AS rn FROM good),
picked AS (SELECT event_id, count(*) AS n_jets, {sides}
  FROM ranked GROUP BY event_id HAVING count(*) >= 2)"""


def _four(side: str) -> dict[str, str]:
    pt, eta, phi, m = (f"{side}_jet_{f}" for f in ("pt", "eta", "phi", "m"))
    px, py, pz = f"{pt}*cos({phi})", f"{pt}*sin({phi})", f"{pt}*sinh({eta})"
    return {
        "px": px,
        "py": py,
        "pz": pz,
        "e": f"sqrt(({px})*({px})+({py})*({py})+({pz})*({pz})+{m}*{m})",
    }


def sql_mass() -> str:
    a, b = _four("leading"), _four("subleading")
    sq = {k: f"(({a[k]})+({b[k]}))*(({a[k]})+({b[k]}))" for k in a}
    return f"sqrt(greatest({sq['e']}-({sq['px']}+{sq['py']}+{sq['pz']}), 0.0))"


SQL_MASSED = f"massed AS (SELECT *, {sql_mass()} AS mjj FROM picked)"


def sql_selected(
    quality: str = QUALITY, balance: float | None = 0.3, mass: float | None = 200.0, source: str = SQL_JETS
) -> str:
    """All CTEs up to ``selected``."""
    conditions = []
    if balance is not None:
        conditions.append(f"subleading_jet_pt / leading_jet_pt >= {balance}")
    if mass is not None:
        conditions.append(f"mjj >= {mass}")
    where = " AND ".join(conditions) or "TRUE"
    return (
        f"WITH {source},\n{sql_pairs_of(quality)},\n{SQL_MASSED},\n"
        f"selected AS (SELECT * FROM massed WHERE {where})"
    )


SQL_OBSERVED_COLUMNS = """abs(leading_jet_eta - subleading_jet_eta) AS delta_y,
    abs(atan2(sin(leading_jet_phi - subleading_jet_phi), cos(leading_jet_phi - subleading_jet_phi))) AS delta_phi,
    exp(abs(leading_jet_eta - subleading_jet_eta)) AS chi,
    (exp(abs(leading_jet_eta - subleading_jet_eta)) - 1) / (exp(abs(leading_jet_eta - subleading_jet_eta)) + 1)
      AS cos_theta_star,
    subleading_jet_pt / leading_jet_pt AS pt_balance,
    leading_jet_pt + subleading_jet_pt AS dijet_pt,
    (leading_jet_pt + subleading_jet_pt) / 2 AS average_pt,
    (leading_jet_eta + subleading_jet_eta) / 2 AS eta_centrality"""


def sql_observed(**options) -> str:
    """All CTEs up to ``obs``."""
    return f"{sql_selected(**options)},\nobs AS (SELECT *, {SQL_OBSERVED_COLUMNS} FROM selected)"


SQL_PAIRS = (
    f"WITH {SQL_JETS},\n{sql_pairs_of('pt > 0')},\n{SQL_MASSED},\n"
    f"obs AS (SELECT *, {SQL_OBSERVED_COLUMNS} FROM massed),\n"
    "pairs AS (SELECT event_id, round(cos_theta_star, 9) AS y_true, round(cos_theta_star*(1+0.1*exp(-mjj/1000.0))"
    "*(1+0.05*cos_theta_star), 9) AS y_pred FROM obs)"
)

SQL_OBS = sql_observed()


def sql_below(share: float, seed: int) -> str:
    """SQL of :func:`jetloom.operators.splits.below` for non-negative ids."""
    a = f"(event_id % {PRIME})"
    b = f"(({a} * {MULTIPLIER} + {seed}) % {PRIME})"
    return f"({b} * ({b} % {FOLD}) + {a}) % {PRIME} < {int(share * PRIME)}"


# The rows detectors are fitted on, as in training_share().
SQL_TRAINING = sql_below(0.5, SEED + 2)


def steady(df: DataFrame) -> DataFrame:
    """Doubles to nine decimals, as in :func:`pairs`, for statistics that depend on ties."""
    return rounded(df, 9)


def rounded(df: DataFrame, digits: int | dict[str, int] = 6) -> DataFrame:
    """Doubles rounded for comparison: one scale, or per-column scales (default 6)."""
    kinds = dict(df.dtypes)

    def one(c: str):
        if kinds[c] not in ("double", "float"):
            return F.col(c)
        places = digits.get(c, 6) if isinstance(digits, dict) else digits
        return F.round(F.col(c).cast("double"), places).alias(c)

    return df.select(*[one(c) for c in df.columns])


def sql_round(columns, digits: int = 6) -> str:
    """``round(c, digits) AS c`` list; items are names or (name, expression)."""
    parts = []
    for c in columns:
        name, expression = (c, c) if isinstance(c, str) else c
        # + 0.0 turns a rounded negative zero into zero.
        parts.append(f"round({expression}, {digits}) + 0.0 AS {name}")
    return ", ".join(parts)
