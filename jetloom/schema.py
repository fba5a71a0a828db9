"""Column layouts shared by the sources, operators and streams."""

from __future__ import annotations

from pyspark.sql import types as T

JET_FIELDS = ("pt", "eta", "phi", "m", "jvt")

JET = T.StructType([T.StructField(f, T.DoubleType()) for f in JET_FIELDS])

# One row per collision, jets as an array of structs (the preferred form).
EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType(), False),
        T.StructField("jets", T.ArrayType(JET)),
    ]
)

# One row per collision, one array per jet property.
PARALLEL_EVENT = T.StructType(
    [T.StructField("event_id", T.LongType(), False)]
    + [T.StructField(f, T.ArrayType(T.DoubleType())) for f in JET_FIELDS]
)

# One row per jet.
FLAT_JET = T.StructType(
    [T.StructField("event_id", T.LongType(), False)]
    + [T.StructField(f, T.DoubleType()) for f in JET_FIELDS]
)

PAIR_SIDES = ("leading", "subleading")
PAIR_FIELDS = ("pt", "eta", "phi", "m")
PAIR_COLUMNS = tuple(f"{s}_jet_{f}" for s in PAIR_SIDES for f in PAIR_FIELDS)

OBSERVABLES = (
    "mjj",
    "delta_y",
    "delta_phi",
    "chi",
    "cos_theta_star",
    "pt_balance",
    "dijet_pt",
    "average_pt",
    "eta_centrality",
)

TARGET = "cos_theta_star"

# Identifiers and lineage: never features.
NON_FEATURES = (
    "event_id",
    "event_index",
    "file_index",
    "chunk_start",
    "source_file",
    "file_path",
    "batch",
)

NUMERIC_TYPES = ("double", "float", "bigint", "int")
