"""Anomaly detection: isolation forest, robust covariance and reconstruction error.

Every detector standardises its inputs, learns a few bounded parameters on the driver
(at most features x features numbers, or 100 small trees) and scores row by row, so
scoring never shuffles.
"""

from __future__ import annotations

import json
import logging
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jetloom.functions.kinematics import nan_low
from jetloom.functions.pvalues import chi2_quantile
from jetloom.operators.distribution import exact_quantiles
from jetloom.operators.scaling import FeatureScaler, ScalerFit
from jetloom.session import stage

METHODS = ("isolation_forest", "elliptic_envelope", "reconstruction", "fourier")
VOTING = ("majority", "unanimous", "any")

CONTAMINATION = 0.05
TREES = 100
SAMPLE_SIZE = 256
TICKETS = 1 << 62
BOTH = "iso_forest_anomaly AND reconstruction_anomaly"
CODE_SIZE = 8
# Random frequencies of the non-linear code.
FREQUENCIES = 64
# A fall of the log determinant that counts as one; smaller ones are rounding.
C_STEP_TOL = 1e-9
# Random starts of the robust covariance, the rows they concentrate on first, and those that go on to all rows.
STARTS = 200
START_SAMPLE = 1500
KEPT_STARTS = 5
# Buckets that narrow a cut down, the rows among which it is found by order, and the bit patterns of all distances.
BUCKETS = 1024
CANDIDATES = 20_000
ALL_BITS = (1 << 63) - 1

LOG = logging.getLogger(__name__)
Estimate = tuple[np.ndarray, np.ndarray]


# ---------------------------------------------------------------- small vector algebra


def _literal_matrix(matrix: np.ndarray) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in matrix])


def _literal_vector(vector: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in vector])


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _times(matrix: np.ndarray, vector: Column) -> Column:
    return F.transform(_literal_matrix(matrix), lambda row: _dot(row, vector))


def _sum_squares(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda s, v: s + v * v)


def _bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# ---------------------------------------------------------------- Fourier features


def draw_frequencies(dimensions: int, count: int, seed: int) -> np.ndarray:
    """``count`` rows of ``dimensions`` frequencies and a phase, for the kernel ``exp(-|a - b|^2 / dimensions)``."""
    rng = np.random.default_rng(seed)
    frequencies = rng.normal(scale=math.sqrt(2.0 / dimensions), size=(count, dimensions))
    return np.hstack([frequencies, rng.uniform(0.0, 2.0 * math.pi, size=(count, 1))])


def fourier_features(vector: Column, frequencies: np.ndarray) -> Column:
    """Cosines of the vector along the frequencies; their dot products approach the kernel of :func:`draw_frequencies`."""
    scale = F.lit(math.sqrt(2.0 / len(frequencies)))
    extended = F.concat(vector, F.array(F.lit(1.0)))
    return _bound(extended, lambda z: F.transform(_literal_matrix(frequencies), lambda row: F.cos(_dot(row, z)) * scale))


def fourier_error(vector: Column, frequencies: np.ndarray, center: np.ndarray, axes: np.ndarray) -> Column:
    """Squared length, in the space of the features, of what the principal ``axes`` (one a row) leave of the vector."""
    centered = F.zip_with(fourier_features(vector, frequencies), _literal_vector(center), lambda a, b: a - b)
    error = _bound(centered, lambda c: _sum_squares(c) - _sum_squares(_times(axes, c)))
    # Rounding may leave a little less than nothing; NULL stays NULL.
    return _bound(error, lambda e: F.when(e < 0.0, 0.0).otherwise(e))


def _upper_quantile(scores: DataFrame, column: str, q: float) -> float:
    return exact_quantiles(scores, [column], [q]).first()["value"]


# ---------------------------------------------------------------- isolation forest


def draw_tree_samples(
    rows: DataFrame, features: Sequence[str], key: str, trees: int, size: int, seed: int
) -> DataFrame:
    """(tree, key, features): for each tree the ``size`` rows with its smallest tickets.

    A ticket hashes the row and the tree: every tree draws from all rows, and a row may
    serve several trees, at any table length. Tickets above a bound that about four times
    the wanted rows stay below are dropped before a row is repeated per tree. The bound
    saves work and does not change the draw.
    """
    columns = rows.select(key, *features)
    expected = 4 * size + 64
    bound = int(TICKETS * min(1.0, expected / max(rows.count(), 1)))

    def ticket(tree: Column) -> Column:
        return F.pmod(F.xxhash64(key, *features, tree, F.lit(seed)), F.lit(TICKETS).cast("bigint"))

    offers = F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), ticket(t).alias("ticket"))
    )
    first = Window.partitionBy("tree").orderBy("_ticket", key, *features)
    return (
        columns.withColumn("_offer", F.explode(F.filter(offers, lambda o: o["ticket"] < F.lit(bound))))
        .select(key, *features, F.col("_offer.tree").alias("tree"), F.col("_offer.ticket").alias("_ticket"))
        .withColumn("_rank", F.row_number().over(first))
        .where(F.col("_rank") <= size)
        .drop("_ticket", "_rank")
    )


def grow_trees(
    samples: DataFrame, features: Sequence[str], key: str, seed: int
) -> list[dict[str, list]]:
    """One random isolation tree per sample, grown in parallel, as flat node arrays."""
    names = list(features)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values([key, *names])[names].to_numpy(dtype="float64")
        rng = np.random.default_rng([seed, tree])
        limit = int(np.ceil(np.log2(max(len(x), 2))))
        split, cut, left, right, size = [], [], [], [], []

        def add(rows: np.ndarray, depth: int) -> int:
            node = len(split)
            split.append(-1), cut.append(0.0), left.append(-1), right.append(-1), size.append(len(rows))
            if depth >= limit or len(rows) <= 1:
                return node
            low, high = rows.min(axis=0), rows.max(axis=0)
            usable = np.flatnonzero(high > low)
            if len(usable) == 0:
                return node
            f = int(rng.choice(usable))
            at = float(rng.uniform(low[f], high[f]))
            mask = rows[:, f] <= at
            if mask.all():
                return node
            split[node], cut[node] = f, at
            left[node] = add(rows[mask], depth + 1)
            right[node] = add(rows[~mask], depth + 1)
            return node

        add(x, 0)
        return pd.DataFrame(
            {"tree": [tree], "split": [split], "cut": [cut], "left": [left], "right": [right], "size": [size]}
        )

    layout = (
        "tree int, split array<int>, cut array<double>, left array<int>, right array<int>, size array<int>"
    )
    grown = samples.groupBy("tree").applyInPandas(grow, layout)
    # One row per tree, of at most twice the sample size in nodes.
    return [row.asDict() for row in grown.orderBy("tree").collect()]


def path_score(trees: list[dict[str, list]], columns: Sequence[Column], sample_size: int) -> Column:
    """Isolation score in (0, 1]: high where few random cuts separate a row."""

    def average_path(n: np.ndarray) -> np.ndarray:
        n = np.asarray(n, dtype="float64")
        safe = np.maximum(n, 3.0)
        long = 2.0 * (np.log(safe - 1.0) + 0.5772156649015329) - 2.0 * (safe - 1.0) / safe
        return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))

    forest = []
    for t in trees:
        split, cut = np.array(t["split"]), np.array(t["cut"])
        left, right = np.array(t["left"]), np.array(t["right"])
        depth = np.zeros(len(split))
        for node in range(len(split)):  # parents precede their children
            if split[node] >= 0:
                depth[left[node]] = depth[right[node]] = depth[node] + 1
        forest.append((split, cut, left, right, depth + average_path(np.array(t["size"])), int(depth.max())))
    normal = float(average_path(np.array([sample_size]))[0]) or 1.0

    @F.pandas_udf("double")
    def isolation(*series: pd.Series) -> pd.Series:
        x = np.column_stack([s.to_numpy(dtype="float64") for s in series])
        total = np.zeros(len(x))
        everyone = np.arange(len(x))
        for split, cut, left, right, length, height in forest:
            node = np.zeros(len(x), dtype="int64")
            for _ in range(height):
                feature = split[node]
                inner = feature >= 0
                goes_left = x[everyone, np.where(inner, feature, 0)] <= cut[node]
                node = np.where(inner, np.where(goes_left, left[node], right[node]), node)
            total += length[node]
        return pd.Series(np.exp2(-(total / len(forest)) / normal))

    return isolation(*columns)


# ---------------------------------------------------------------- robust covariance


def vector_moments(rows: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, mean and population covariance of an array column, one aggregation."""
    outer = F.flatten(F.transform(vector, lambda a: F.transform(vector, lambda b: a * b)))
    vectors = rows.select(array_to_vector(F.col(vector)).alias("_v"), array_to_vector(outer).alias("_vv"))
    row = vectors.agg(
        F.count(F.lit(1)).alias("n"),
        Summarizer.mean(F.col("_v")).alias("mean"),
        Summarizer.mean(F.col("_vv")).alias("second"),
    ).first()
    mean = row["mean"].toArray()
    second = row["second"].toArray().reshape(len(mean), len(mean))
    return row["n"], mean, second - np.outer(mean, mean)


def _whitener(cov: np.ndarray) -> np.ndarray:
    """W with W'W = pseudo-inverse of cov; directions without variance are dropped."""
    values, vectors = np.linalg.eigh(cov)
    usable = values > max(values.max(), 0.0) * 1e-10
    return (vectors[:, usable] / np.sqrt(values[usable])).T


def _distances(columns: np.ndarray, mean: np.ndarray, white: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared lengths of the whitened vectors (one a column) and the centered vectors; sums run in a fixed order."""
    centered = columns - mean[:, None]
    total = np.zeros(columns.shape[1])
    for weights in white:
        along = np.zeros(columns.shape[1])
        for weight, component in zip(weights, centered):
            along += weight * component
        total += along * along
    return total, centered


def mahalanobis(vector: Column, mean: np.ndarray, cov: np.ndarray) -> Column:
    """Squared Mahalanobis distance as a column expression; NULL where the vector or a component is."""
    white, d = _whitener(cov), len(mean)

    @F.arrow_udf("double")
    def distance(vectors: pa.Array) -> pa.Array:
        flat = vectors.flatten()
        missing = vectors.is_null().to_numpy(zero_copy_only=False).copy()
        part = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, d).any(axis=1)
        out = np.zeros(len(vectors))
        out[~missing] = _distances(flat.to_numpy(zero_copy_only=False).reshape(-1, d).T, mean, white)[0]
        missing[~missing] = part
        return pa.array(out, mask=missing)

    return distance(vector)


def _log_det(cov: np.ndarray) -> tuple[int, float]:
    """Rank and log determinant on it: of two halves the flatter one, then the smaller one, is denser."""
    values = np.linalg.eigvalsh(cov)
    usable = values[values > max(values.max(), 0.0) * 1e-10]
    return len(usable), float(np.log(usable).sum())


def _falls(new: tuple[int, float], old: tuple[int, float]) -> bool:
    return new[0] < old[0] or (new[0] == old[0] and new[1] < old[1] - C_STEP_TOL)


def _distinct(estimates: list[Estimate]) -> list[Estimate]:
    """Starts that have met count once."""
    out: list[Estimate] = []
    for mean, cov in estimates:
        if not any(np.allclose(mean, m, atol=1e-9) and np.allclose(cov, c, rtol=1e-6, atol=1e-12) for m, c in out):
            out.append((mean, cov))
    return out


def sample_starts(x: np.ndarray, starts: int, keep: int, seed: int) -> list[Estimate]:
    """The ``keep`` densest estimates that random starts of features + 1 rows reach on a bounded sample.

    Every start takes two concentration steps; the best go on to convergence.
    """
    n, d = x.shape
    half = min(n, (n + d + 1) // 2)
    rng = np.random.default_rng(seed)

    def step(estimate: Estimate) -> Estimate:
        mean, cov = estimate
        distance = (((x - mean) @ _whitener(cov).T) ** 2).sum(axis=1)
        near = x[np.argsort(distance, kind="stable")[:half]]
        return near.mean(axis=0), np.cov(near.T, bias=True).reshape(d, d)

    found = []
    for _ in range(starts):
        few = x[rng.choice(n, min(n, d + 1), replace=False)]
        estimate = few.mean(axis=0), np.cov(few.T, bias=True).reshape(d, d)
        found.append(step(step(estimate)))
    found = sorted(_distinct(found), key=lambda e: _log_det(e[1]))[:keep]
    settled = []
    for estimate in found:
        while True:
            new = step(estimate)
            if not _falls(_log_det(new[1]), _log_det(estimate[1])):
                break
            estimate = new
        settled.append(estimate)
    return sorted(_distinct(settled), key=lambda e: _log_det(e[1]))


def _ticket(seed: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(TICKETS).cast("bigint"))


def _start_sample(rows: DataFrame, vector: str, n: int, size: int, ticket: Column) -> np.ndarray:
    """About ``size`` vectors by ticket: the bound comes before the sort, so no task meets more than a few times that."""
    bound = int(TICKETS * min(1.0, (2 * size + 64) / max(n, 1)))
    few = rows.select(vector, ticket.alias("_offer")).where(F.col("_offer") < F.lit(bound)).dropDuplicates()
    # At most `size` vectors.
    return np.array([r[0] for r in few.orderBy("_offer", vector).limit(size).select(vector).collect()], dtype="float64")


def _blocks(rows: DataFrame, vector: str) -> DataFrame:
    """The vectors in blocks of at most one Arrow batch, components first: a pass over them costs no work per row outside numpy."""

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array([x.T.tobytes()], pa.binary())], ["block"])

    return rows.select(F.col(vector).cast("array<double>")).where(F.col(vector).isNotNull()).mapInArrow(pack, "block binary")


def _per_partition(blocks: DataFrame, d: int, start, add, finish) -> list[tuple]:
    """``finish(state)`` of every partition, its blocks added to ``start()`` one by one: a few small arrays each."""

    def run(batches):
        state = start()
        for batch in batches:
            for block in batch.column(0):
                add(state, np.frombuffer(block.as_buffer(), np.float64).reshape(d, -1))
        found = [np.ascontiguousarray(part) for part in finish(state)]
        yield pa.RecordBatch.from_arrays([pa.array([[p.tobytes() for p in found]], pa.list_(pa.binary()))], ["parts"])

    return [tuple(row["parts"]) for row in blocks.mapInArrow(run, "parts array<binary>").collect()]


@dataclass
class _Bracket:
    """Bit patterns ``[low, high)`` of the distances of one estimate that hold the wanted rank; ``below`` are under them."""

    low: int
    high: int
    below: int = 0
    inside: int | None = None
    rank: int = 0

    @property
    def width(self) -> int:
        return -(-(self.high - self.low) // BUCKETS)

    @property
    def settled(self) -> bool:
        return self.inside is not None and (self.inside <= CANDIDATES or self.high - self.low == 1)


def _bits(distances: np.ndarray) -> np.ndarray:
    """Distances as integers of the same order: none is negative."""
    return distances.view(np.int64)


def _first_bracket(estimate: Estimate, share: float, sample: np.ndarray | None) -> _Bracket:
    """Where the sample says the share's cut lies; a wrong guess costs a pass, not the result."""
    if sample is None or len(sample) < 100:
        return _Bracket(0, ALL_BITS)
    mean, cov = estimate
    ordered = np.sort(_distances(sample.T, mean, _whitener(cov))[0])
    place, spread = share * len(ordered), 2.5 * math.sqrt(len(ordered))
    low, high = (int(_bits(ordered)[int(np.clip(k, 0, len(ordered) - 1))]) for k in (place - spread, place + spread))
    return _Bracket(low, high + 1)


def _brackets(blocks: DataFrame, estimates: list[Estimate], share: float, sample: np.ndarray | None) -> list[_Bracket]:
    """Brackets of the distance that ``share`` of the rows do not pass, narrowed by bucket counts until few rows are inside."""
    brackets = [_first_bracket(e, share, sample) for e in estimates]
    d = len(estimates[0][0])
    while True:
        todo = [k for k, b in enumerate(brackets) if not b.settled]
        if not todo:
            return brackets
        asked = [(estimates[k][0], _whitener(estimates[k][1]), brackets[k].low, brackets[k].width) for k in todo]

        def add(counts: np.ndarray, block: np.ndarray) -> None:
            for slot, (mean, white, low, width) in enumerate(asked):
                distance = _distances(block, mean, white)[0]
                bits = _bits(distance[~np.isnan(distance)])
                bucket = np.clip((bits - low) // width, -1, BUCKETS) + 1
                counts[slot] += np.bincount(bucket, minlength=BUCKETS + 2)

        parts = _per_partition(
            blocks, d, lambda: np.zeros((len(asked), BUCKETS + 2), np.int64), add, lambda counts: (counts,)
        )
        counts = sum(np.frombuffer(p, np.int64).reshape(len(asked), -1) for (p,) in parts)
        for slot, k in enumerate(todo):
            old, upto = brackets[k], np.cumsum(counts[slot])
            rank = min(max(1, math.ceil(share * int(upto[-1]))), int(upto[-1]))
            bucket = int(np.searchsorted(upto, rank))
            edges = [0, *(min(old.low + i * old.width, ALL_BITS) for i in range(BUCKETS + 1)), ALL_BITS]
            inside = int(counts[slot][bucket])
            brackets[k] = _Bracket(edges[bucket], edges[bucket + 1], int(upto[bucket]) - inside, inside, rank)


def _below(
    blocks: DataFrame, estimates: list[Estimate], brackets: list[_Bracket]
) -> list[tuple[float, int, np.ndarray, np.ndarray]]:
    """Per estimate the cut, and count, mean and covariance of the rows at most that far; one pass.

    Rows under the bracket are summed where they are; the few inside it come back to be ordered.
    """
    d = len(estimates[0][0])
    # A bracket of one value is its cut: all rows that hold it are within.
    asked = [
        (mean, _whitener(cov), b.high if b.high - b.low == 1 else b.low, b.high)
        for (mean, cov), b in zip(estimates, brackets, strict=True)
    ]

    def start():
        return [[0, np.zeros(d), np.zeros((d, d)), [], []] for _ in asked]

    def add(state, block: np.ndarray) -> None:
        for own, (mean, white, low, high) in zip(state, asked):
            distance, centered = _distances(block, mean, white)
            bits, known = _bits(distance), ~np.isnan(distance)
            near, open_ = known & (bits < low), known & (bits >= low) & (bits < high)
            inner = centered[:, near]
            own[0] += inner.shape[1]
            own[1] += inner.sum(axis=1)
            own[2] += np.einsum("an,bn->ab", inner, inner)
            if open_.any():
                own[3].append(distance[open_])
                own[4].append(centered[:, open_].T)

    def finish(state):
        for n, first, second, distance, vectors in state:
            yield np.concatenate(([float(n)], first, second.ravel()))
            yield np.concatenate([np.zeros(0), *distance])
            yield np.concatenate([np.zeros((0, d)), *vectors])

    parts = _per_partition(blocks, d, start, add, finish)
    out = []
    for k, ((mean, _), bracket) in enumerate(zip(estimates, brackets, strict=True)):
        sums = sum(np.frombuffer(p[3 * k]) for p in parts)
        distance = np.concatenate([np.frombuffer(p[3 * k + 1]) for p in parts])
        vectors = np.concatenate([np.frombuffer(p[3 * k + 2]).reshape(-1, d) for p in parts])
        if len(distance):
            cut = float(np.sort(distance)[bracket.rank - bracket.below - 1])
        else:
            cut = float(np.array([bracket.low]).view(np.float64)[0])
        vectors = vectors[distance <= cut]
        n = int(sums[0]) + len(vectors)
        first = (sums[1 : d + 1] + vectors.sum(axis=0)) / n
        second = (sums[d + 1 :].reshape(d, d) + vectors.T @ vectors) / n
        out.append((cut, n, mean + first, second - np.outer(first, first)))
    return out


def _within(blocks: DataFrame, estimate: Estimate, cut: float) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance of the rows nearer than ``cut``."""
    bits = int(np.array([cut]).view(np.int64)[0])
    # An empty bracket: all rows under it, none to be ordered.
    return _below(blocks, [estimate], [_Bracket(bits, bits)])[0][1:]


def _concentrated(blocks: DataFrame, estimates: list[Estimate], core: float, sample: np.ndarray | None) -> list[Estimate]:
    brackets = _brackets(blocks, estimates, core, sample)
    return [(mean, cov) for _, _, mean, cov in _below(blocks, estimates, brackets)]


def concentrate(rows: DataFrame, vector: str, estimates: list[Estimate], core: float) -> list[Estimate]:
    """One concentration step of every estimate over all rows: bucket counts for the exact cuts, one pass for the moments."""
    return _concentrated(_blocks(rows, vector), estimates, core, None)


def robust_covariance(
    rows: DataFrame,
    vector: str,
    starts: int = STARTS,
    sample_size: int = START_SAMPLE,
    seed: int = 42,
    ticket: str | None = None,
) -> Estimate:
    """Location and covariance of the densest half, then of all consistent rows.

    Random starts concentrate on a sample of ``sample_size`` rows; the best of them and the estimate from all rows
    concentrate together on all rows: keep the rows nearest under the current estimate, re-estimate, leave a start when
    its determinant no longer falls. It falls with every other step and there are finitely many halves, so no bound on
    the steps is needed. The smallest determinant wins. ``ticket`` names a column in [0, 2^62) that draws the sample; by
    default the vector is hashed, which a vector that varies in its last digits does not repeat.
    """
    n, *everything = vector_moments(rows, vector)
    d = len(everything[0])
    core = min(1.0, (n + d + 1) / 2.0 / n)
    sample = _start_sample(rows, vector, n, sample_size, F.col(ticket) if ticket else _ticket(seed, vector))
    blocks = stage(_blocks(rows, vector))
    moving = [tuple(everything), *sample_starts(sample, starts, KEPT_STARTS, seed)]
    # What a start brings from the sample or from all rows is no half of all rows yet.
    moving = [(e, (d + 1, math.inf)) for e in moving]
    settled: list[tuple[Estimate, tuple[int, float]]] = []
    step = 0
    while moving:
        stepped = _concentrated(blocks, [e for e, _ in moving], core, sample)
        step += 1
        going, seen = [], []
        for (old, height), new in zip(moving, stepped, strict=True):
            lower = _log_det(new[1])
            if not _falls(lower, height):
                settled.append((old, height))
            elif len(_distinct([*seen, new])) > len(seen):
                seen.append(new)
                going.append((new, lower))
        moving = going
        LOG.info("concentration step %d: %d starts go on, log determinants %s", step, len(moving), [h[1] for _, h in moving])
    (mean, cov), _ = min(settled, key=lambda s: s[1])
    rank = len(_whitener(cov))
    median = _below(blocks, [(mean, cov)], _brackets(blocks, [(mean, cov)], 0.5, sample))[0][0]
    cov = cov * (median / chi2_quantile(0.5, rank))
    kept, new_mean, new_cov = _within(blocks, (mean, cov), chi2_quantile(0.975, rank))
    return (new_mean, new_cov) if kept > rank else (mean, cov)


# ---------------------------------------------------------------- detectors


class AnomalyDetector:
    """Fit on presumed ordinary events, then flag the contamination share's outliers.

    ``trees`` and ``sample_size`` (rows a tree is grown from) are the isolation forest's. ``reconstruction`` rebuilds a row
    from its principal axes, a linear code; ``fourier`` does so in the space of random Fourier features, which follows
    curved shapes.
    """

    def __init__(
        self,
        method: str = "reconstruction",
        contamination: float = CONTAMINATION,
        seed: int = 42,
        key: str = "event_id",
        trees: int = TREES,
        sample_size: int = SAMPLE_SIZE,
    ):
        if method not in METHODS:
            raise ValueError(f"Unknown anomaly detection method: {method}")
        self.method, self.contamination, self.seed, self.key = method, contamination, seed, key
        self.trees, self.sample_size = trees, sample_size
        self.scaler: ScalerFit | None = None
        self.features: list[str] = []
        self.threshold: float | None = None

    def fit(self, train: DataFrame, features: Sequence[str]) -> dict[str, float]:
        """Learn scaling, the detector and its threshold; returns the fit summary."""
        self.features = list(features)
        train = stage(train.select(self.key, *self.features))
        self.scaler = FeatureScaler("standard").fit(train, self.features)
        fitted = getattr(self, f"_fit_{self.method}")(train)
        scores = stage(train.select(self._raw_score().alias("_score")))
        self.threshold = _upper_quantile(scores, "_score", 1.0 - self.contamination)
        return {"threshold": self.threshold, "contamination": self.contamination, **fitted}

    def detect(self, rows: DataFrame, score: str = "anomaly_score", flag: str = "is_anomaly") -> DataFrame:
        """Add the score and the outlier flag to every row.

        Isolation scores are reported relative to the threshold (positive = anomalous). A row
        without a score (a NULL or NaN feature) is not flagged.
        """
        if self.threshold is None:
            raise ValueError("detector is not trained yet: call fit first")
        raw = rows.withColumn("_raw_score", self._raw_score())
        shown = F.col("_raw_score")
        if self.method == "isolation_forest":
            shown = shown - F.lit(self.threshold)
        return raw.withColumns(
            {score: shown, flag: F.coalesce(nan_low("_raw_score") > F.lit(self.threshold), F.lit(False))}
        ).drop("_raw_score")

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the fitted parameters (bounded by features squared or 100 small trees)."""
        if self.threshold is None:
            raise ValueError("detector is not trained yet: call fit first")
        state: dict[str, object] = {
            "method": self.method,
            "contamination": self.contamination,
            "seed": self.seed,
            "key": self.key,
            "features": self.features,
            "threshold": self.threshold,
            "scaler": self.scaler.parameters,
        }
        if self.method == "isolation_forest":
            state["sample_size"] = self._sample_size
            state.update({f"tree {i:04d}": tree for i, tree in enumerate(self._trees)})
        elif self.method == "elliptic_envelope":
            state["location"] = [part.tolist() for part in self._location]
        elif self.method == "fourier":
            state["fourier"] = [part.tolist() for part in self._fourier]
        else:
            state["projection"] = self._projection.tolist()
        rows = [(name, json.dumps(value)) for name, value in state.items()]
        table = spark.createDataFrame(rows, "name string, value string")
        table.coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "AnomalyDetector":
        """Read a detector written by :meth:`save`."""
        rows = spark.read.parquet(path).collect()
        state = {r["name"]: json.loads(r["value"]) for r in rows}
        out = AnomalyDetector(state["method"], state["contamination"], state["seed"], state["key"])
        out.features, out.threshold = state["features"], state["threshold"]
        out.scaler = ScalerFit("standard", {f: tuple(p) for f, p in state["scaler"].items()})
        if out.method == "isolation_forest":
            out._sample_size = state["sample_size"]
            out._trees = [state[name] for name in sorted(state) if name.startswith("tree ")]
        elif out.method == "elliptic_envelope":
            out._location = tuple(np.array(part) for part in state["location"])
        elif out.method == "fourier":
            out._fourier = tuple(np.array(part) for part in state["fourier"])
        else:
            out._projection = np.array(state["projection"])
        return out

    def reconstruction_quality(self, rows: DataFrame) -> DataFrame:
        """Total, per-feature, largest and mean absolute error, and the reconstruction."""
        if self.method != "reconstruction":
            raise ValueError("reconstruction quality needs the reconstruction method")
        if self.threshold is None:
            raise ValueError("detector is not trained yet: call fit first")
        rebuilt = rows.withColumn("_z", F.array(*self._scaled())).withColumn(
            "_back", _times(self._projection, F.col("_z"))
        )
        residual = F.zip_with("_z", "_back", lambda a, b: a - b)
        d = F.lit(float(len(self.features)))
        centers = _literal_vector([self.scaler.parameters[f][0] for f in self.features])
        scales = _literal_vector([self.scaler.parameters[f][1] for f in self.features])
        return rebuilt.withColumn("_r", residual).select(
            *rows.columns,
            (_sum_squares(F.col("_r")) / d).alias("total_reconstruction_error"),
            F.transform("_r", lambda v: v * v).alias("feature_wise_errors"),
            F.array_max(F.transform("_r", lambda v: v * v)).alias("max_feature_error"),
            (F.aggregate("_r", F.lit(0.0), lambda s, v: s + F.abs(v)) / d).alias("mean_absolute_error"),
            F.zip_with(
                F.zip_with("_back", scales, lambda b, s: b * s), centers, lambda b, c: b + c
            ).alias("reconstructed_features"),
        )

    def _scaled(self) -> list[Column]:
        return [
            (F.col(f).cast("double") - F.lit(c)) / F.lit(s)
            for f, (c, s) in ((f, self.scaler.parameters[f]) for f in self.features)
        ]

    def _raw_score(self) -> Column:
        if self.method == "isolation_forest":
            return path_score(self._trees, self._scaled(), self._sample_size)
        z = F.array(*self._scaled())
        if self.method == "elliptic_envelope":
            return mahalanobis(z, *self._location)
        if self.method == "fourier":
            return fourier_error(z, *self._fourier)
        # The residual of an orthogonal projection P is (I - P) z.
        leftover = np.eye(len(self.features)) - self._projection
        return _sum_squares(_times(leftover, z)) / F.lit(float(len(self.features)))

    def _fit_isolation_forest(self, train: DataFrame) -> dict[str, float]:
        samples = draw_tree_samples(train, self.features, self.key, self.trees, self.sample_size, self.seed)
        self._trees = grow_trees(self.scaler.transform(samples), self.features, self.key, self.seed)
        self._sample_size = max(t["size"][0] for t in self._trees)
        return {"n_estimators": len(self._trees)}

    def _fit_elliptic_envelope(self, train: DataFrame) -> dict[str, float]:
        # Tickets come from the unscaled columns: scaling differs in its last digits between partitionings.
        ticket = _ticket(self.seed, self.key, *self.features)
        rows = stage(train.select(F.array(*self._scaled()).alias("_z"), ticket.alias("_ticket")))
        self._location = robust_covariance(rows, "_z", seed=self.seed, ticket="_ticket")
        return {}

    def _fit_reconstruction(self, train: DataFrame) -> dict[str, float]:
        rows = stage(train.select(array_to_vector(F.array(*self._scaled())).alias("_z")))
        code = min(CODE_SIZE, len(self.features))
        axes = PCA(k=code, inputCol="_z", outputCol="_code").fit(rows).pc.toArray()
        self._projection = axes @ axes.T
        return {"code_size": code}

    def _fit_fourier(self, train: DataFrame) -> dict[str, float]:
        frequencies = draw_frequencies(len(self.features), FREQUENCIES, self.seed)
        rows = stage(train.select(array_to_vector(fourier_features(F.array(*self._scaled()), frequencies)).alias("_z")))
        center = rows.agg(Summarizer.mean(F.col("_z"))).first()[0].toArray()
        axes = PCA(k=CODE_SIZE, inputCol="_z", outputCol="_code").fit(rows).pc.toArray().T
        self._fourier = (frequencies, center, axes)
        return {"code_size": CODE_SIZE, "frequencies": FREQUENCIES}


class EnsembleAnomalyDetector:
    """Several detectors side by side on the same row, combined by a vote."""

    def __init__(
        self,
        methods: Sequence[str] = ("reconstruction", "isolation_forest"),
        contamination: float = CONTAMINATION,
        seed: int = 42,
        key: str = "event_id",
    ):
        self.detectors = {m: AnomalyDetector(m, contamination, seed, key) for m in methods}

    def fit(self, train: DataFrame, features: Sequence[str]) -> dict[str, dict[str, float]]:
        """Fit every detector on the same training rows."""
        train = stage(train)
        return {m: d.fit(train, features) for m, d in self.detectors.items()}

    def detect(self, rows: DataFrame, voting: str = "majority") -> DataFrame:
        """Per-method columns plus the mean score and the vote."""
        for method, detector in self.detectors.items():
            rows = detector.detect(rows, f"{method}_score", f"{method}_anomaly")
        return combine_votes(
            rows,
            [f"{m}_score" for m in self.detectors],
            [f"{m}_anomaly" for m in self.detectors],
            voting,
        )


def combine_votes(
    rows: DataFrame, scores: Sequence[str], flags: Sequence[str], voting: str = "majority"
) -> DataFrame:
    """Mean score and majority (more than half), unanimous or any vote over columns."""
    if voting not in VOTING:
        raise ValueError(f"Unknown voting strategy: {voting}")
    votes = sum((F.col(f).cast("int") for f in flags), F.lit(0))
    needed = {
        "majority": votes > F.lit(len(flags) / 2),
        "unanimous": votes == F.lit(len(flags)),
        "any": votes > F.lit(0),
    }[voting]
    mean_score = sum((F.col(s) for s in scores), F.lit(0.0)) / F.lit(float(len(scores)))
    return rows.withColumns({"ensemble_score": mean_score, "ensemble_anomaly": needed})


def anomaly_rate(rows: DataFrame, flag: str = "is_anomaly") -> DataFrame:
    """Count and share of flagged rows, one row."""
    return rows.agg(
        F.count_if(F.col(flag)).alias("n_anomalies"),
        F.count(F.lit(1)).alias("n_events"),
        F.avg(F.col(flag).cast("double")).alias("anomaly_rate"),
    )


def compare_detectors(first: DataFrame, second: DataFrame, key: str = "event_id") -> DataFrame:
    """Join two stored score tables on the event id and flag what both call anomalous.

    The id must be unique in each table: one held k times would pair with itself k x k
    times, so it fails the job. :func:`detect_both` has no such limit.
    """

    def unique(scores: DataFrame, score: str, flag: str) -> DataFrame:
        single = F.count(F.lit(1)) == 1
        repeated = F.raise_error(F.concat(F.lit("repeated id in a score table: "), F.col(key).cast("string")))
        return scores.where(F.col(key).isNotNull()).groupBy(key).agg(
            F.first("anomaly_score").alias(score),
            F.when(single, F.first("is_anomaly")).otherwise(repeated.cast("boolean")).alias(flag),
        )

    a = unique(first, "iso_forest_score", "iso_forest_anomaly")
    b = unique(second, "reconstruction_error", "reconstruction_anomaly")
    return a.join(b, key).withColumn("both_anomaly", F.expr(BOTH))


def detect_both(
    first: AnomalyDetector, second: AnomalyDetector, rows: DataFrame, key: str = "event_id"
) -> DataFrame:
    """Two detectors' outputs on the same rows, side by side: no join, repeated ids stay."""
    seen = first.detect(rows, "iso_forest_score", "iso_forest_anomaly")
    seen = second.detect(seen, "reconstruction_error", "reconstruction_anomaly")
    return seen.select(
        key,
        "iso_forest_score",
        "iso_forest_anomaly",
        "reconstruction_error",
        "reconstruction_anomaly",
        F.expr(BOTH).alias("both_anomaly"),
    )
