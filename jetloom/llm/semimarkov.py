"""Personal data by patterns and a semi-Markov conditional random field.

Patterns give the base spans. The field adds spans the patterns miss (a phone number without its plus sign, say): text
around digits and at-signs is cut into tokens, every run of up to ``MAX_TOKENS`` tokens is scored as a whole for every
kind by features of the complete span, and bounded-length dynamic programming picks boundaries and kinds together. A
span of the field counts when it overlaps no base span and its posterior odds against "nothing here" pass a margin.

The field learns from base spans in a bounded sample of texts and from rewritten copies of them (plus sign dropped,
separators changed), with version numbers, keys and failing numbers of the same texts as counterexamples.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jetloom.llm.staging import narrow, smallest_by_hash
from jetloom.llm.text import chunks, text_bytes

KINDS = ("email", "ip", "card", "phone")
#: Longest entity in tokens; email addresses and spaced card numbers fit.
MAX_TOKENS = 15
#: Characters of a long zone that are decoded together, and how far the next window lies.
WINDOW, STEP = 480, 400

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# Starts nowhere inside a run of digits: a match takes whole runs, and a long run is scanned once.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\w\s]|\s|\w")
ZONE = re.compile(r"[^\s0-9@]{0,64}[0-9@]\S*(?:[\x20\t]?[^\s0-9@]{0,3}[0-9@]\S*)*")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    """Leftmost matches: one attempt per at-sign, from the start of the local part before it."""
    out: list[Span] = []
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = EMAIL.match(text, start) if start < at else None
        if found:
            out.append(("email", start, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    return out


def _byte(digits: str) -> bool:
    """At most 255, however many digits."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by kind as listed, then start (code points, end exclusive)."""
    out = emails(text)
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(map(_byte, m.group().split(".")))]
    for m in CARD.finditer(text):
        digits = _digits(m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def render(spans: list[Span]) -> str:
    """``kind:start:end`` by kind as listed, then start, joined by commas."""
    ordered = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered)


N_FEATURES = 34


def span_features(zone: str, start: int, end: int) -> np.ndarray:
    """Features of a whole candidate span within its zone."""
    out = np.zeros(N_FEATURES)
    s = zone[start:end]
    digits = _digits(s)
    n = len(digits)
    letters = sum(c.isalpha() for c in s)
    before = zone[start - 1] if start else " "
    after = zone[end] if end < len(zone) else " "
    groups = [len(g) for g in re.findall(r"[0-9]+", s)]
    out[0] = 1
    out[1] = "@" in s
    out[2] = EMAIL.fullmatch(s) is not None
    out[3] = bool(re.fullmatch(r"[A-Za-z0-9._%+-]+\s?@\s?[A-Za-z0-9-]+(\s?\.\s?[A-Za-z0-9-]+)+", s))
    out[4] = IP.fullmatch(s) is not None
    out[5] = bool(out[4]) and all(map(_byte, s.split(".")))
    out[6] = CARD.fullmatch(s) is not None
    out[7] = 13 <= n <= 19
    out[8] = bool(out[6] and out[7]) and luhn(digits)
    out[9] = PHONE.fullmatch(s) is not None
    out[10] = 9 <= n <= 15
    out[11] = bool(out[9] and out[10])
    out[12] = s[:1] == "+"
    out[13] = bool(re.fullmatch(r"(\+?[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", s))
    out[14] = bool(re.fullmatch(r"\+?[0-9][0-9().\x20-]*[0-9]", s))
    out[15] = letters == 0
    out[16] = letters > 0 and n > 0
    out[17] = min(letters / max(len(s), 1), 1)
    out[18] = before.isalnum() or before in "@+"
    out[19] = after.isalnum() or after == "@"
    out[20] = before in ".-" and start > 1 and zone[start - 2].isdigit()
    out[21] = after in ".-" and end + 1 < len(zone) and zone[end + 1].isdigit()
    out[22] = s[:1].isspace() or s[-1:].isspace()
    out[23] = not (s[:1].isalnum() or s[:1] in "+(") or not (s[-1:].isalnum())
    out[24] = n == 0
    out[25] = 0 < n < 7
    out[26] = n > 19
    out[27] = len(groups) >= 3
    out[28] = len(groups) == 1
    out[29] = max(groups, default=0) == 4 and n == 16
    out[30] = "." in s and not out[4] and not out[1]
    out[31] = "(" in s and ")" in s
    out[32] = bool(re.search(r"[0-9][\x20(-]{0,2}$", zone[:start]))
    out[33] = bool(re.match(r"[\x20)-]{0,2}[0-9]", zone[end:]))
    return out


@dataclass
class Zone:
    """Token bounds of a zone and the candidate segments ``(i, j)`` with their features; other segments are single tokens outside."""

    text: str
    bounds: list[int]
    segments: list[tuple[int, int]]
    features: np.ndarray


def zone_of(text: str) -> Zone:
    tokens = list(TOKEN.finditer(text))
    bounds = [t.start() for t in tokens] + [len(text)]
    has = [any(c.isdigit() or c == "@" for c in t.group()) for t in tokens]
    segments = []
    for i in range(len(tokens)):
        if tokens[i].group().isspace():
            continue
        for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
            if tokens[j - 1].group().isspace() or not any(has[i:j]) or j - i < 2 and bounds[j] - bounds[i] < 7:
                continue
            segments.append((i, j))
    features = np.array([span_features(text, bounds[i], bounds[j]) for i, j in segments]).reshape(len(segments), N_FEATURES)
    return Zone(text, bounds, segments, features)


class SemiMarkovField:
    """Weights per kind; the outside label scores 0 for each token, so a segment competes with its tokens left alone."""

    def __init__(self, weights: np.ndarray | None = None, margin: float = 2.0):
        self.weights = np.zeros((len(KINDS), N_FEATURES)) if weights is None else weights
        self.margin = margin

    def _forward(self, zone: Zone, scores: np.ndarray) -> np.ndarray:
        n = len(zone.bounds) - 1
        ends: list[list[int]] = [[] for _ in range(n + 1)]
        for s, (_, j) in enumerate(zone.segments):
            ends[j].append(s)
        alpha = np.full(n + 1, -np.inf)
        alpha[0] = 0
        for j in range(1, n + 1):
            total = alpha[j - 1]
            for s in ends[j]:
                total = np.logaddexp(total, alpha[zone.segments[s][0]] + np.logaddexp.reduce(scores[s]))
            alpha[j] = total
        return alpha

    def _backward(self, zone: Zone, scores: np.ndarray) -> np.ndarray:
        n = len(zone.bounds) - 1
        starts: list[list[int]] = [[] for _ in range(n + 1)]
        for s, (i, _) in enumerate(zone.segments):
            starts[i].append(s)
        beta = np.full(n + 1, -np.inf)
        beta[n] = 0
        for i in range(n - 1, -1, -1):
            total = beta[i + 1]
            for s in starts[i]:
                total = np.logaddexp(total, beta[zone.segments[s][1]] + np.logaddexp.reduce(scores[s]))
            beta[i] = total
        return beta

    def gradient(self, zone: Zone, gold: dict[tuple[int, int], int]) -> np.ndarray:
        """Observed less expected features: the log-likelihood's gradient."""
        scores = zone.features @ self.weights.T
        alpha, beta = self._forward(zone, scores), self._backward(zone, scores)
        out = np.zeros_like(self.weights)
        for s, (i, j) in enumerate(zone.segments):
            chance = np.exp(alpha[i] + scores[s] + beta[j] - alpha[-1])
            kind = gold.get((i, j))
            if kind is not None:
                chance[kind] -= 1
            if np.abs(chance).max() > 1e-6:
                out -= chance[:, None] * zone.features[s][None, :]
        return out

    def decode(self, zone: Zone) -> list[tuple[int, int, int]]:
        """Best segmentation: ``(kind, start, end)`` of the segments that beat the outside by the margin."""
        if not zone.segments:
            return []
        scores = zone.features @ self.weights.T - self.margin
        best_kind = scores.argmax(axis=1)
        n = len(zone.bounds) - 1
        value, back = [0.0] * (n + 1), [-1] * (n + 1)
        ends: list[list[int]] = [[] for _ in range(n + 1)]
        for s, (_, j) in enumerate(zone.segments):
            ends[j].append(s)
        for j in range(1, n + 1):
            value[j] = value[j - 1]
            for s in ends[j]:
                v = value[zone.segments[s][0]] + scores[s, best_kind[s]]
                if v > value[j]:
                    value[j], back[j] = v, s
        found, j = [], n
        while j > 0:
            if back[j] < 0:
                j -= 1
                continue
            i, end = zone.segments[back[j]]
            found.append((int(best_kind[back[j]]), zone.bounds[i], zone.bounds[end]))
            j = i
        return found[::-1]


def _rewrites(zone: str, spans: list[Span]) -> list[tuple[str, list[Span]]]:
    """The zone itself, and copies in which one span is written in a way the patterns miss."""
    out = [(zone, spans)]
    for kind, a, b in spans:
        own = zone[a:b]
        if kind == "phone":
            bare = re.sub(r"^\+[0-9]{1,3}[\x20.-]*", "", own)
            for new in {own[1:], bare, bare.replace("(", "").replace(")", "").replace(" ", "-"), bare.replace(") ", ".").replace("(", "").replace("-", ".")}:
                if len(_digits(new)) >= 9:
                    out.append((f"{new}", [(kind, 0, len(new))]))
        if kind == "email":
            new = own.replace("@", " @ ")
            out.append((new, [(kind, 0, len(new))]))
    return out


def fit(texts: list[str], epochs: int = 12, rate: float = 0.4, ridge: float = 0.002, most: int = 50, longest: int = 120) -> SemiMarkovField:
    """A field from base spans and their rewritten copies.

    At most ``most`` zones of each make-up (kinds, rewritten or not, with or without letters) and none of more than
    ``longest`` characters are learned from; both are bounds of the fit alone.
    """
    seen: dict[tuple, int] = {}
    examples: list[tuple[Zone, dict[tuple[int, int], int]]] = []
    for text in texts:
        spans = base_spans(text)
        for m in ZONE.finditer(text):
            inside = [(k, a - m.start(), b - m.start()) for k, a, b in spans if m.start() <= a and b <= m.end()]
            # Overlapping base spans of two kinds cannot both be segments: the first listed kind counts.
            chosen: list[Span] = []
            for s in inside:
                if all(s[2] <= c[1] or s[1] >= c[2] for c in chosen):
                    chosen.append(s)
            for zone_text, gold_spans in _rewrites(m.group(), chosen):
                make_up = tuple(sorted({s[0] for s in gold_spans})), zone_text != m.group(), bool(re.search("[A-Za-z]", zone_text))
                if len(zone_text) > longest or seen.get(make_up, 0) >= most:
                    continue
                seen[make_up] = seen.get(make_up, 0) + 1
                zone = zone_of(zone_text)
                at = {b: k for k, b in enumerate(zone.bounds)}
                gold = {(at[a], at[b]): KINDS.index(k) for k, a, b in gold_spans if a in at and b in at}
                examples.append((zone, {g: k for g, k in gold.items() if g in set(zone.segments)}))
    field = SemiMarkovField()
    squares = np.full_like(field.weights, 1e-6)
    for _ in range(epochs):
        for zone, gold in examples:
            step = field.gradient(zone, gold) - ridge * field.weights
            squares += step**2
            field.weights += rate * step / np.sqrt(squares)
    return field


class _Taken:
    """Which stretches of a text lie in known spans, by binary search."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.ends = list(accumulate((b for _, b in spans), max))

    def covers(self, a: int, b: int) -> bool:
        """Whether one span holds all of ``a`` to ``b``."""
        k = bisect_right(self.starts, a) - 1
        return k >= 0 and self.ends[k] >= b

    def meets(self, a: int, b: int) -> bool:
        """Whether a span overlaps ``a`` to ``b``."""
        k = bisect_left(self.starts, b) - 1
        return k >= 0 and self.ends[k] > a


def decoded(whole: str, field: SemiMarkovField) -> list[Span]:
    """Spans of a zone, decoded in windows of ``WINDOW`` characters.

    A span that touches the inner end of a window may be a stump: the next window starts with it. Other windows start
    ``STEP`` further, or where the last span ended.
    """
    out: list[Span] = []
    lo, done = 0, 0
    while True:
        hi = min(len(whole), lo + WINDOW)
        ahead = lo + STEP
        for kind, a, b in sorted(field.decode(zone_of(whole[lo:hi])), key=lambda s: s[1]):
            a, b = lo + a, lo + b
            if hi < len(whole) and (a >= ahead or b == hi and a > lo):
                ahead = min(a, ahead)
                break
            if a >= done:
                out.append((KINDS[kind], a, b))
                done = b
        if hi == len(whole):
            return out
        lo = max(ahead, done, lo + 1)


def all_spans(text: str, field: SemiMarkovField) -> tuple[list[Span], list[Span]]:
    """``(base, added)`` spans of a text."""
    base = base_spans(text)
    added: list[Span] = []
    taken = _Taken([(a, b) for _, a, b in base])
    for m in ZONE.finditer(text):
        at = m.start()
        if all(taken.covers(at + t.start(), at + t.end()) for t in re.finditer(r"[0-9]+|@", m.group())):
            continue  # every number here belongs to a base span
        added += [(kind, at + a, at + b) for kind, a, b in decoded(m.group(), field) if not taken.meets(at + a, at + b)]
    return base, added


def fit_on(docs: DataFrame, text: str = "text", fit_docs: int = 1500) -> SemiMarkovField:
    """Field from at most ``fit_docs`` texts (a documented bound) holding digits or at-signs, smallest hash first."""
    rows = narrow(docs, text=text).filter(F.col("text").rlike("[0-9@]"))
    rows = rows.select(F.xxhash64("text").alias("h"), "text")
    rows = smallest_by_hash(rows, "h", fit_docs, "text")
    return fit(rows.toArrow()["text"].to_pylist())


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find(docs: DataFrame, field: SemiMarkovField, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts and digest of the base spans, ``spans`` (base and added) and ``n_added``.

    NULL and empty texts have no spans. Offsets are code points of the whole text. Other columns are ignored; equal
    texts get equal results; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        own = shared.value
        marks = np.zeros(256, bool)
        marks[ord("0") : ord("9") + 1] = marks[ord("@")] = True
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            # Only texts with a digit or an at-sign can hold anything.
            candidates = np.zeros(batch.num_rows, bool)
            for lo, hi in chunks(offsets):
                running = np.concatenate(([0], np.cumsum(marks[data[offsets[lo] : offsets[hi]]], dtype=np.int64)))
                own_offsets = offsets[lo : hi + 1] - offsets[lo]
                candidates[lo:hi] = running[own_offsets[1:]] > running[own_offsets[:-1]]
            counts = np.zeros((4, batch.num_rows), np.int64)
            digest = [hashlib.sha256(b"").hexdigest()] * batch.num_rows
            spans, extra = [""] * batch.num_rows, [0] * batch.num_rows
            for d in np.flatnonzero(candidates):
                base, added = all_spans(batch.column(1)[int(d)].as_py(), own)
                for kind, _, _ in base:
                    counts[KINDS.index(kind), d] += 1
                digest[d] = hashlib.sha256(render(base).encode()).hexdigest()
                spans[d] = render(base + added)
                extra[d] = len(added)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c) for c in counts), pa.array(digest), pa.array(spans), pa.array(extra, pa.int64())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    rows = narrow(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, RESULT)
