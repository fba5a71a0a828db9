"""Toxicity by compression distance: two zstandard dictionaries, window by window.

An ordinary dictionary is trained on windows of ordinary documents. The toxic one is trained on the toxic documents'
passages around character runs that toxic documents use far more often, and extends the ordinary one, so that plain
text compresses alike under both and only toxic wording makes a difference. A text is cut into overlapping byte windows;
the window's gain is its compressed length under the ordinary dictionary less that under the toxic one. The score is a
logistic calibration of the text's gains, learned from labelled texts that the dictionaries have not seen.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jetloom.llm.staging import drop_rows, narrow, smallest_by_hash, with_row_id
from jetloom.llm.text import IS_PUNCTUATION, LOWER, chunks, gram_hashes, text_bytes, words_of

#: Bytes of a window and of its advance: words of up to WINDOW - STEP bytes lie whole in some window.
WINDOW, STEP = 40, 24
#: Gains of at least so many bytes are counted as separate evidence.
STRONG = 3
FEATURES = 5


@dataclass(frozen=True)
class ToxicityPlan:
    """Bounds of the fit, documented parameters: the driver reads at most ``fit_docs`` labelled texts of the toxic class
    and ``plain_times`` as many ordinary ones. A character run marks toxic wording when at least ``purity`` of
    its documents are toxic and that would arise by chance with a probability below ``exp(-evidence)`` among all runs tried.
    """

    fit_docs: int = 2000
    plain_times: int = 3
    dictionary_bytes: int = 4096
    toxic_bytes: int = 16_384
    run_lengths: tuple[int, ...] = (4, 5, 6, 7)
    purity: float = 0.9
    evidence: float = 3.0
    least_docs: int = 3
    threshold: float = 0.3


@dataclass
class ToxicityModel:
    """Both dictionaries' contents and the calibration."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    bias: float
    threshold: float
    _compressors: list = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_compressors": None}

    def compressors(self):
        if self._compressors is None:
            self._compressors = []
            for content in (self.ordinary, self.ordinary + self.toxic):
                made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                parameters = zstandard.ZstdCompressionParameters.from_level(
                    3, source_size=WINDOW, dict_size=len(content), min_match=5, write_content_size=0, write_checksum=0, write_dict_id=0
                )
                made.precompute_compress(compression_params=parameters)
                self._compressors.append(zstandard.ZstdCompressor(dict_data=made, compression_params=parameters))
        return self._compressors

    def gains(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Compressed-length difference of every window, in bytes."""
        if not len(starts):
            return np.zeros(0)
        spans = np.empty((len(starts), 2), np.uint64)
        spans[:, 0], spans[:, 1] = starts, ends - starts
        windows = zstandard.BufferWithSegments(data.tobytes(), spans.tobytes())
        lengths = []
        for compressor in self.compressors():
            out = compressor.multi_compress_to_buffer(windows)
            lengths.append(np.fromiter((len(out[k]) for k in range(len(out))), np.int64, len(out)))
        return (lengths[0] - lengths[1]).astype(float)

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per document: largest and second largest gain, strong windows, strong windows' gain, log of the number of windows."""
        starts, ends, first = windows_of(offsets)
        gain = self.gains(data, starts, ends)
        out = np.zeros((len(offsets) - 1, FEATURES))
        for d in range(len(out)):
            own = gain[first[d] : first[d + 1]]
            if not len(own):
                continue
            top = np.partition(own, -2)[-2:] if len(own) > 1 else np.array([0.0, own[0]])
            strong = own[own >= STRONG]
            out[d] = max(top[1], 0) / 4, max(top[0], 0) / 4, np.log1p(len(strong)), np.log1p(strong.sum()), np.log1p(len(own)) / 4
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights + self.bias, -30, 30)))


def windows_of(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows ``[start, end)`` covering every byte of every document, and each document's first window."""
    size = np.diff(offsets)
    count = np.where(size > 0, 1 + np.maximum(0, -(-(size - WINDOW) // STEP)), 0)
    first = np.concatenate(([0], np.cumsum(count)))
    doc = np.repeat(np.arange(len(size)), count)
    starts = offsets[:-1][doc] + (np.arange(len(doc)) - first[doc]) * STEP
    return starts, np.minimum(starts + WINDOW, offsets[1:][doc]), first


def _runs(words: list[bytes], lengths: tuple[int, ...]) -> set[bytes]:
    """Distinct character runs within words, a blank standing for a word's start."""
    return {w[k : k + n] for w in words for n in lengths for k in range(len(w) - n + 1)}


def _divergence(p: float, q: float) -> float:
    return sum(x * np.log(x / y) for x, y in ((p, q), (1 - p, 1 - q)) if x > 0)


def _train(samples: list[bytes], size: int) -> bytes:
    """Dictionary content by the library's cover training; too few samples are taken as they are."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


class _DocWords:
    """The words of each document with a leading blank, cut out on demand; hashes are made in chunks and dropped."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.spans = data, []
        for lo, hi in chunks(offsets):
            words = words_of(data, offsets[lo : hi + 1], breaks=IS_PUNCTUATION)
            for d in range(hi - lo):
                own = slice(words.first[d], words.first[d + 1])
                self.spans.append((words.start[own] + offsets[lo], words.end[own] + offsets[lo]))

    def __getitem__(self, d: int) -> list[bytes]:
        start, end = self.spans[d]
        if not len(start):
            return []
        first = int(start[0])
        raw = self.data[first : end[-1]].tobytes()
        return [b" " + raw[a - first : b - first] for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def _least_shingles(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Smallest five-word shingle hash of each text: equal for copies, mostly equal for near copies."""
    out = []
    for lo, hi in chunks(offsets):
        words = words_of(data, offsets[lo : hi + 1])
        out += [int(g.min()) if len(g := gram_hashes(words.of(d), 5)) else 0 for d in range(hi - lo)]
    return out


def fit(texts: pa.Array, toxic: np.ndarray, prior: float, plan: ToxicityPlan = ToxicityPlan()) -> ToxicityModel:
    """Train dictionaries on one half of the texts and calibrate on the other; ``prior`` is the share of toxic texts."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    words = _DocWords(data, offsets)
    # Copies and near copies of one text are one piece of evidence: of equal least shingles the first text counts.
    first = np.zeros(len(toxic), bool)
    first[np.unique(_least_shingles(data, offsets), return_index=True)[1]] = True
    half = (np.arange(len(toxic)) % 2 == 0) & first
    if not (half & toxic).any() or not (half & ~toxic).any():
        half = first
    found: Counter = Counter()
    for d in np.flatnonzero(half & toxic):
        found.update(_runs(list(dict.fromkeys(words[d])), plan.run_lengths))
    frequent = {run for run, n in found.items() if n >= plan.least_docs}
    elsewhere: Counter = Counter()
    for d in np.flatnonzero(half & ~toxic):
        elsewhere.update(_runs(list(dict.fromkeys(words[d])), plan.run_lengths) & frequent)
    share = max(1, int((half & toxic).sum())) / max(2, int(half.sum()))
    tested = [(run, found[run], elsewhere[run]) for run in frequent]
    # Chernoff bound of so many of a run's documents being toxic by chance, corrected for the number of runs tried.
    limit = np.log(max(len(tested), 1)) + plan.evidence
    marked = {run for run, a, b in tested if a / (a + b) >= max(plan.purity, share) and (a + b) * _divergence(a / (a + b), share) >= limit}
    toxic_samples, plain_samples = [], []
    for d in np.flatnonzero(half):
        if toxic[d]:
            toxic_samples += [w for w in words[d] if not marked.isdisjoint(_runs([w], plan.run_lengths))]
        else:
            own = words[d]
            plain_samples += [b"".join(own[k : k + 12]) for k in range(0, len(own), 40)]
    # Frequent wording last: the nearest content is the cheapest to refer to; equal counts go by spelling.
    common = sorted(Counter(toxic_samples).items(), key=lambda x: (-x[1], x[0]))
    toxic_content = b"".join(w for w, _ in reversed(common))[-plan.toxic_bytes :]
    if len(toxic_content) >= plan.toxic_bytes:
        toxic_content = _train(toxic_samples, plan.toxic_bytes)
    model = ToxicityModel(_train(plain_samples or [b" "], plan.dictionary_bytes) or b" ", toxic_content or b" ", np.zeros(FEATURES), 0.0, plan.threshold)
    rest = ~half if (~half & toxic).any() and (~half & ~toxic).any() else np.ones(len(toxic), bool)
    parts = [model.features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in chunks(offsets)]
    features = np.concatenate(parts)[rest]
    model.weights, model.bias = _logistic(features, toxic[rest].astype(float), prior)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, prior: float, ridge: float = 0.02) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by Newton steps; classes are weighted back to their shares in the table."""
    weight = np.where(y > 0, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    design = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(design.shape[1])
    penalty = np.full(len(beta), ridge)
    penalty[-1] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + penalty * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta[:-1], float(beta[-1])


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves the given remainder."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % parts == part, F.lit(False))


def bounded_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: tuple[int, int]) -> tuple[pa.Table, float]:
    """At most ``per_class[k]`` labelled usable texts of class k, smallest hash of the id first, and the share of class 1.

    Labels other than 0 and 1 and rows without text are left out; an id with both labels counts as 1.
    """
    known = (
        narrow(labels, doc_id="doc_id", label=label).filter(F.col("label").isin(0, 1) & usable)
        .groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    )
    share = known.agg(F.avg("label")).first()[0]
    order = F.xxhash64("doc_id")
    chosen = [
        smallest_by_hash(known.filter(F.col("label") == k).withColumn("_h", order), "_h", most, "doc_id").drop("_h")
        for k, most in enumerate(per_class)
    ]
    texts = narrow(docs, doc_id="doc_id", text="text").filter("text IS NOT NULL")
    table = texts.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").orderBy(order, "doc_id", "text").select("text", "label").toArrow()
    return table, float(share or 0.0)


def fit_on(docs: DataFrame, labels: DataFrame, plan: ToxicityPlan = ToxicityPlan()) -> ToxicityModel:
    """Model from a bounded sample of the labelled rows that are not held out.

    Without rows of both classes the model is neutral: every score is the share of toxic rows.
    """
    table, prior = bounded_sample(docs, labels, "toxic", ~held_out(F.col("doc_id"), 4, 2), (plan.fit_docs * plan.plain_times, plan.fit_docs))
    toxic = table["label"].to_numpy() == 1
    if not toxic.any() or toxic.all():
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return ToxicityModel(b" ", b" ", np.zeros(FEATURES), float(np.log(p / (1 - p))), plan.threshold)
    return fit(table["text"], toxic, prior, plan)


def score(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every row from its whole text.

    NULL and empty texts have no window and get the calibration's base score. Other columns are ignored; rows are
    scored one by one, so repeated rows and ties get equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in chunks(offsets):
                part = LOWER[data[offsets[lo] : offsets[hi]]]
                value = own.scores(own.features(part, offsets[lo : hi + 1] - offsets[lo]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(value), pa.array((value >= own.threshold).astype(np.int32))],
                    ["doc_id", "score", "predicted"],
                )

    rows = narrow(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, plan: ToxicityPlan = ToxicityPlan(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents not predicted toxic, all columns. Rows are told apart by id and text, so NULL ids are judged too."""
    rows = with_row_id(docs, doc_id, text)
    return drop_rows(rows, score(rows, fit_on(docs, labels, plan), "_jetloom_row_id", text).filter("predicted = 1"))
