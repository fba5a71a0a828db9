"""Text quality by a factorisation machine.

A text is a sparse vector: hashed words (log frequency, unit length), structure statistics, and metadata (text length).
The machine scores ``b + <w, x> + sum over pairs <v_i, v_j> x_i x_j`` with low-rank factors; by the sum-of-squares
identity the pair term is ``(sum_f (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2) / 2``, linear in the non-zero entries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jetloom.llm.compression_toxicity import bounded_sample, held_out
from jetloom.llm.staging import narrow
from jetloom.llm.text import chunks, gram_hashes, text_bytes, words_of

STATISTICS = 14


@dataclass(frozen=True)
class QualityPlan:
    """``fit_docs`` bounds the labelled texts of each class that the driver reads."""

    fit_docs: int = 3000
    buckets: int = 1 << 14
    rank: int = 8
    epochs: int = 12
    batch: int = 64
    least_steps: int = 1200
    rate: float = 0.05
    decay: float = 1e-4
    threshold: float = 0.3
    seed: int = 5


@dataclass
class Sparse:
    """Rows of (column, value) entries; row r holds entries ``first[r]:first[r+1]``, never none."""

    column: np.ndarray
    value: np.ndarray
    first: np.ndarray

    def rows(self, which: np.ndarray) -> "Sparse":
        size = np.diff(self.first)[which]
        first = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(self.first[which] - first[:-1], size) + np.arange(first[-1])
        return Sparse(self.column[at], self.value[at], first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def statistics(text: np.ndarray, words, d: int, tokens: np.ndarray) -> np.ndarray:
    """Structure and length of one text, each about 0 to 1."""
    out = np.zeros(STATISTICS)
    out[0] = 1.0
    n, n_bytes = len(tokens), len(text)
    if not n_bytes:
        return out
    kinds = np.bincount(text, minlength=256) / n_bytes
    out[1] = np.log1p(n) / 10
    out[2] = np.log1p(n_bytes) / 12
    out[3] = kinds[ord("A") : ord("Z") + 1].sum()
    out[4] = kinds[ord("0") : ord("9") + 1].sum()
    out[5] = kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()
    out[6] = kinds[128:].sum()
    out[7] = min(1.0, 20 * kinds[10])
    if n:
        span = slice(words.first[d], words.first[d + 1])
        length = words.end[span] - words.start[span]
        out[8] = min(1.0, length.mean() / 20)
        out[9] = min(1.0, length.std() / 10)
        out[10] = len(np.unique(tokens)) / n
        out[11] = (tokens[1:] == tokens[:-1]).mean() if n > 1 else 0.0
        grams = gram_hashes(tokens, 4)
        out[12] = len(np.unique(grams)) / len(grams)
        out[13] = min(1.0, length.max() / 60)
    return out


def vectors(column: pa.Array, buckets: int) -> Sparse:
    """Sparse vectors of whole texts: ``STATISTICS`` dense columns first, then the word buckets."""
    data, offsets = text_bytes(column)
    columns, values, sizes = [], [], []
    for lo, hi in chunks(offsets):
        words = words_of(data, offsets[lo : hi + 1])
        for d in range(hi - lo):
            tokens = words.of(d)
            dense = statistics(data[offsets[lo + d] : offsets[lo + d + 1]], words, d, tokens)
            bucket, count = np.unique(tokens % np.uint64(buckets), return_counts=True)
            weight = np.log1p(count)
            if len(weight):
                weight = weight / np.sqrt((weight**2).sum())
            columns += [np.arange(STATISTICS), bucket.astype(np.int64) + STATISTICS]
            values += [dense, weight]
            sizes.append(STATISTICS + len(bucket))
    if not sizes:
        return Sparse(np.zeros(0, np.int64), np.zeros(0), np.zeros(1, np.int64))
    return Sparse(np.concatenate(columns), np.concatenate(values), np.concatenate(([0], np.cumsum(sizes))))


@dataclass
class FactorizationMachine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    buckets: int
    threshold: float

    def margin(self, x: Sparse) -> tuple[np.ndarray, np.ndarray]:
        """Raw score of every row, and the factor sums it came from."""
        if len(x.first) == 1:
            return np.zeros(0), np.zeros((0, self.factor.shape[1]))
        scaled = self.factor[x.column] * x.value[:, None]
        total = np.add.reduceat(scaled, x.first[:-1])
        squares = np.add.reduceat((scaled**2).sum(axis=1), x.first[:-1])
        linear = np.add.reduceat(self.weight[x.column] * x.value, x.first[:-1])
        return self.bias + linear + ((total**2).sum(axis=1) - squares) / 2, total

    def scores(self, x: Sparse) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x)[0], -30, 30)))


def fit(x: Sparse, y: np.ndarray, prior: float, plan: QualityPlan = QualityPlan()) -> FactorizationMachine:
    """Logistic loss by AdaGrad; classes are weighted back to their shares in the table."""
    rng = np.random.default_rng(plan.seed)
    columns = STATISTICS + plan.buckets
    model = FactorizationMachine(
        float(np.log(prior / (1 - prior))), np.zeros(columns), rng.normal(0, 0.05, (columns, plan.rank)), plan.buckets, plan.threshold
    )
    balance = np.where(y > 0, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    seen_b, seen_w, seen_v = 1e-6, np.full(columns, 1e-6), np.full((columns, plan.rank), 1e-6)
    epochs = max(plan.epochs, -(-plan.least_steps * plan.batch // len(y)))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), plan.batch):
            which = order[lo : lo + plan.batch]
            part = x.rows(which)
            margin, total = model.margin(part)
            slope = balance[which] * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[which]) / len(which)
            touched, at = np.unique(part.column, return_inverse=True)
            entry = slope[part.row] * part.value
            grad_w = np.bincount(at, entry, len(touched)) + plan.decay * model.weight[touched]
            own = entry[:, None] * (total[part.row] - model.factor[part.column] * part.value[:, None])
            grad_v = np.stack([np.bincount(at, own[:, f], len(touched)) for f in range(plan.rank)], axis=1) + plan.decay * model.factor[touched]
            seen_w[touched] += grad_w**2
            seen_v[touched] += grad_v**2
            seen_b += slope.sum() ** 2
            model.weight[touched] -= plan.rate * grad_w / np.sqrt(seen_w[touched])
            model.factor[touched] -= plan.rate * grad_v / np.sqrt(seen_v[touched])
            model.bias -= plan.rate * slope.sum() / np.sqrt(seen_b)
    return model


def fit_on(docs: DataFrame, labels: DataFrame, plan: QualityPlan = QualityPlan()) -> FactorizationMachine:
    """Model from a bounded sample of the labelled rows that are not held out; one class alone gives a constant score."""
    table, prior = bounded_sample(docs, labels, "quality", ~held_out(F.col("doc_id"), 5, 0), (plan.fit_docs, plan.fit_docs))
    y = table["label"].to_numpy().astype(float)
    if not y.any() or y.all():
        p = min(max(prior, 1e-6), 1 - 1e-6)
        columns = STATISTICS + plan.buckets
        return FactorizationMachine(float(np.log(p / (1 - p))), np.zeros(columns), np.zeros((columns, plan.rank)), plan.buckets, plan.threshold)
    return fit(vectors(table["text"], plan.buckets), y, prior, plan)


def score(docs: DataFrame, model: FactorizationMachine, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every row from its whole text.

    NULL and empty texts are scored from their (zero) statistics. Other columns are ignored; equal texts get equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for lo, hi in chunks(offsets):
                value = own.scores(vectors(batch.column(1).slice(lo, hi - lo), own.buckets))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(value), pa.array((value >= own.threshold).astype(np.int32))],
                    ["doc_id", "score", "predicted"],
                )

    rows = narrow(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")
