"""Centroid clustering of integer vectors, nearest centroids found by a tournament of bisector tests.

For two centroids ``i < j`` the points nearer to ``j`` lie beyond a plane: ``2 x . (c_j - c_i) > |c_j|^2 - |c_i|^2``.
Normals and thresholds of all pairs are integers and computed once a round; a vector then passes ``k - 1`` sign tests,
each of which eliminates one centroid (equality eliminates the larger number). Only the winner's distance is computed.

Every round is one scan of the vectors. A task returns at most ``k`` rows of component sums, so neither hot vectors nor
hot clusters meet in one task; the driver holds ``k`` centroids of ``dims`` numbers and never a vector more.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jetloom.llm.staging import narrow, staged

#: Vectors tested together: their gathered normals stay in the processor's cache.
BLOCK = 2048
LONG_MAX = 2**63 - 1


@dataclass(frozen=True)
class CentroidPlan:
    clusters: int = 40
    dims: int = 64
    rounds: int = 5
    scale: int = 256
    seed: int = 2

    @property
    def limit(self) -> int:
        """Largest magnitude of a component for which all tests and distances are exact in 64 bits."""
        return isqrt(2**58 // self.dims)


class Bisectors:
    """Normals and thresholds of all pairs ``i < j`` of a list of integer centroids."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        squares = (centroids * centroids).sum(axis=1)
        self.normals = 2 * (centroids[None, :, :] - centroids[:, None, :])
        self.thresholds = squares[None, :] - squares[:, None]

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        """Number of the nearest centroid of every row; ties go to the smaller number."""
        winner = np.zeros(len(vectors), np.int64)
        for start in range(0, len(vectors), BLOCK):
            block = vectors[start : start + BLOCK]
            holder = winner[start : start + BLOCK]
            for rival in range(1, len(self.centroids)):
                side = np.einsum("ij,ij->i", block, self.normals[holder, rival])
                holder[side > self.thresholds[holder, rival]] = rival
        return winner

    def distances(self, vectors: np.ndarray, winner: np.ndarray) -> np.ndarray:
        """Squared distances to the given centroids."""
        out = np.empty(len(vectors), np.int64)
        for start in range(0, len(vectors), BLOCK):
            gap = vectors[start : start + BLOCK] - self.centroids[winner[start : start + BLOCK]]
            out[start : start + BLOCK] = np.einsum("ij,ij->i", gap, gap)
        return out


def integer_vectors(table: DataFrame, vector: str, plan: CentroidPlan) -> DataFrame:
    """``(vec_id, x)``: rows with exactly ``dims`` finite components, each as ``floor(scale * component)``.

    Integers are held within ``plan.limit`` (2^26 for 64 components), where all arithmetic is exact.
    """
    x = F.col("x")

    def whole(value: Column) -> Column:
        return F.greatest(F.least(F.floor(value * F.lit(float(plan.scale))), F.lit(plan.limit)), F.lit(-plan.limit)).cast("int")

    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = narrow(table, vec_id="vec_id", x=vector).withColumn("x", x.cast("array<double>"))
    return rows.filter((F.size(x) == plan.dims) & finite).select("vec_id", F.transform(x, whole).alias("x"))


def first_centroids(vectors: DataFrame, plan: CentroidPlan) -> np.ndarray:
    """The vectors of the smallest hashes; repeated ids are ordered by their components."""
    key = F.concat(F.lit(f"{plan.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.select(F.sha2(key, 256).alias("hash"), "x").orderBy("hash", "x").limit(plan.clusters).collect()
    return np.array([r.x for r in rows], np.int64).reshape(len(rows), plan.dims)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _component_sums(bisectors: Bisectors):
    k, dims = bisectors.centroids.shape

    def run(batches):
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            vectors = _matrix(batch.column("x"), dims)
            winner = bisectors.nearest(vectors)
            np.add.at(sums, winner, vectors)
            counts += np.bincount(winner, minlength=k)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int32()), pa.array(counts[held]), pa.array(list(sums[held]), pa.list_(pa.int64()))],
            ["cluster", "members", "sums"],
        )

    return run


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: exact floors of the means, empty clusters unchanged."""
    parts = vectors.select("x").mapInArrow(_component_sums(Bisectors(centroids)), "cluster int, members long, sums array<long>")
    spread = parts.select("cluster", "members", F.posexplode("sums").alias("position", "part"))
    exact = "decimal(38,0)"
    totals = spread.groupBy("cluster", "position").agg(
        F.sum(F.col("part").cast(exact)).alias("total"), F.sum(F.col("members").cast(exact)).alias("members")
    )
    out = centroids.copy()
    for row in totals.collect():  # clusters x dims rows
        out[row.cluster, row.position] = int(row.total) // int(row.members)
    return out


def _assign(bisectors: Bisectors, schema: pa.Schema):
    dims = bisectors.centroids.shape[1]

    def run(batches):
        for batch in batches:
            vectors = _matrix(batch.column("x"), dims)
            winner = bisectors.nearest(vectors)
            distance = pa.array(bisectors.distances(vectors, winner))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(winner, pa.int32()), distance], schema=schema)

    return run


def cluster(table: DataFrame, vector: str = "embedding", plan: CentroidPlan = CentroidPlan()) -> DataFrame:
    """Clusters of the vectors of ``table(vec_id, <vector>)``.

    Returns ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``, a row per kept vector: rows whose
    vector is NULL, has another length than ``plan.dims`` or holds a NULL or non-finite component are left out. Equal
    rows stay apart, a NULL ``vec_id`` hashes as an empty one, other columns are ignored. With fewer vectors than
    clusters every vector starts a centroid; an empty table gives an empty result. Inertias beyond 64 bits are held at
    the largest long.
    """
    vectors = staged(integer_vectors(table, vector, plan), "vectors")
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    centroids = first_centroids(vectors, plan)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame(
            [], f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        )
    for _ in range(plan.rounds):
        centroids = moved(vectors, centroids)
    bisectors = Bisectors(centroids)
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = pa.schema([("vec_id", to_arrow_type(vectors.schema["vec_id"].dataType)), ("cluster", pa.int32()), ("distance", pa.int64())])
    assigned = staged(vectors.mapInArrow(_assign(bisectors, arrow), f"vec_id {id_type}, cluster int, distance long"), "assigned")

    found = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()  # clusters rows
    everything = sum(int(r.total) for r in found)
    rows = [
        (
            r.cluster,
            min(int(r.total), LONG_MAX),
            min(everything, LONG_MAX),
            hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest(),
        )
        for r in found
    ]
    sums = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # A row per cluster.
    return assigned.join(F.broadcast(sums), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
