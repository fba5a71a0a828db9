"""Benchmark decontamination by spaced-seed hashing.

Texts are runs of letters and digits, lower-cased; punctuation and white space only separate. A seed is a fixed mask
over consecutive tokens: the hash covers the positions marked 1 and ignores those marked 0, so a substituted token under
a 0 does not hide the match. Benchmark seeds go into a table and a fixed-size bitmap; document positions that pass the
bitmap are joined to the table by hash. Every hit is a diagonal (document position minus item position), and the tokens
around it are compared along that diagonal, substitutions allowed.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jetloom.llm.staging import KeyBitmap, drop_rows, narrow, probe, split_mix, staged, with_row_id
from jetloom.llm.text import IS_PUNCTUATION, chunks, text_bytes, words_of

SEED_BITMAP_BITS = 1 << 24


@dataclass(frozen=True)
class LeakPlan:
    """Masks, and the overlap that counts as a leak.

    An overlap has at least ``least_words`` equal tokens (or a whole shorter item), and at least ``share`` of its
    tokens equal. The default masks hit every overlap that the default rule accepts, wherever its substitutions lie:
    one of 32 or more tokens has a half that is accepted too, and a test enumerates the shorter ones.
    """

    masks: tuple[str, ...] = ("11110111", "11101001011", "1101000000011011", "101001100111", "11110010101")
    least_words: int = 13
    share: float = 0.8


def seed_hashes(tokens: np.ndarray, mask: str, number: int) -> np.ndarray:
    """One hash per position at which the mask fits; it depends on the tokens under the ones only."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    key = np.full(n, np.uint64(number + 1))
    for at, mark in enumerate(mask):
        if mark == "1":
            key = split_mix(key ^ tokens[at : at + n]) + np.uint64(at)
    return key


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int, plan: LeakPlan) -> tuple[int, int, int] | None:
    """Largest overlap on a diagonal that the plan accepts: ``(first item token, end, equal tokens)`` or None.

    Of all runs with at least ``share`` equal tokens the one with most of them, then the shortest, then the first. With
    matches worth ``1 - share`` and mismatches ``-share``, a run has the share if its sum is not negative, so the best
    run from a start ends at the last prefix sum that is not below the start's.
    """
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if hi <= lo:
        return None
    equal = doc[lo + diagonal : hi + diagonal] == item[lo:hi]
    at = np.flatnonzero(equal)
    if len(at) < min(plan.least_words, len(item)):
        return None
    # Whole numbers, so that a run with exactly the share counts.
    share = Fraction(str(plan.share))
    total = np.concatenate(([0], np.cumsum(np.where(equal, share.denominator - share.numerator, -share.numerator))))
    highest = np.maximum.accumulate(total[::-1])[::-1]
    end = len(total) - np.searchsorted(highest[::-1], total[at])
    same = np.searchsorted(at, end - 1) - np.arange(len(at))
    # Mismatches at the end of a run only lengthen it.
    end = at[np.arange(len(at)) + same - 1] + 1
    k = int(np.lexsort((end - at, -same))[0])
    if same[k] < min(plan.least_words, len(item)):
        return None
    return lo + int(at[k]), lo + int(end[k]), int(same[k])


def _item_seeds(plan: LeakPlan):
    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            words = words_of(data, offsets, breaks=IS_PUNCTUATION)
            ids = batch.column(0).to_pylist()
            rows: list[tuple[int, int, int]] = []
            for d, item in enumerate(ids):
                tokens = words.of(d)
                for number, mask in enumerate(plan.masks):
                    for at, h in enumerate(seed_hashes(tokens, mask, number).view(np.int64).tolist()):
                        rows.append((h, item, at))
                if 0 < len(tokens) < plan.least_words:
                    # It leaks only as a whole: the whole item is a seed.
                    rows.append((int(seed_hashes(tokens, "1" * len(tokens), 100 + len(tokens)).view(np.int64)[0]), item, 0))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["seed", "item_id", "item_at"])

    return run


def _tokens(batches):
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for lo, hi in chunks(offsets):
            words = words_of(data, offsets[lo : hi + 1], breaks=IS_PUNCTUATION)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array([words.of(d).tobytes() for d in range(hi - lo)], pa.binary())], ["id", "tokens"]
            )


def _doc_hits(plan: LeakPlan, shared, bits: int, short: list[int]):
    """Positions of documents whose seed may be in the benchmark."""

    def run(batches):
        words_table = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in chunks(offsets):
                words = words_of(data, offsets[lo : hi + 1], breaks=IS_PUNCTUATION)
                keys, docs, ats = [], [], []
                seeds = [(mask, number) for number, mask in enumerate(plan.masks)] + [("1" * n, 100 + n) for n in short]
                for mask, number in seeds:
                    # All documents of the chunk at once; positions whose mask crosses a document's end are left out.
                    key = seed_hashes(words.hashes, mask, number)
                    if not len(key):
                        continue
                    at = np.flatnonzero(probe(words_table, key.view(np.int64), bits))
                    doc = np.searchsorted(words.first, at, side="right") - 1
                    inside = at + len(mask) <= words.first[doc + 1]
                    at, doc = at[inside], doc[inside]
                    keys.append(key[at].view(np.int64))
                    docs.append(doc)
                    ats.append(at - words.first[doc])
                if keys:
                    doc = np.concatenate(docs)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys)), batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array(np.concatenate(ats))],
                        ["seed", "doc_id", "doc_at"],
                    )

    return run


def _verify(plan: LeakPlan):
    """The best overlap of a document and an item over all their diagonals."""

    def run(batches):
        for batch in batches:
            columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            rows = []
            for k in range(batch.num_rows):
                doc, item = (np.frombuffer(columns[c][k].as_buffer(), np.uint64) for c in ("doc_tokens", "item_tokens"))
                best = None
                for diagonal in columns["diagonals"][k].as_py():
                    found = overlap(doc, item, diagonal, plan)
                    if found:
                        start, end, same = found
                        rank = (-same, end - start, start + diagonal, start)
                        best = min(best, rank) if best else rank
                if best:
                    same, length, at = -best[0], best[1], best[2]
                    rows.append((columns["doc_id"][k].as_py(), columns["item_id"][k].as_py(), at, at + length, length, same, len(item)))
            names = ["doc_id", "item_id", "doc_start", "doc_end", "words", "equal_words", "item_words"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(7)], names)

    return run


def leaks(
    docs: DataFrame, benchmark: DataFrame, plan: LeakPlan = LeakPlan(),
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per document and benchmark item that overlap: the longest verified overlap.

    Columns ``doc_id, item_id, doc_start, doc_end`` (token numbers), ``words, equal_words, item_words, similarity``.
    NULL and empty texts on either side have no tokens and match nothing; NULL ids are left out; items shorter than
    ``least_words`` leak only as a whole; rows that repeat an id are looked at together. Empty tables give an empty result.
    """
    docs = narrow(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    items = narrow(benchmark, item_id=item_id, text=item_text).select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL")
    seeds = staged(items.mapInArrow(_item_seeds(plan), "seed long, item_id long, item_at long").distinct(), "seeds")
    bitmap = KeyBitmap(seeds, "seed", SEED_BITMAP_BITS)
    item_tokens = staged(items.mapInArrow(_tokens, "item_id long, item_tokens binary"), "items")
    width = F.octet_length("item_tokens") / 8
    short = [int(r[0]) for r in item_tokens.filter((width > 0) & (width < plan.least_words)).select(width).distinct().collect()]
    hits = docs.mapInArrow(_doc_hits(plan, bitmap.shared, bitmap.bits, short), "seed long, doc_id long, doc_at long")
    met = hits.join(seeds, "seed").select("doc_id", "item_id", (F.col("doc_at") - F.col("item_at")).alias("diagonal")).distinct()
    met = staged(met, "hits")
    ids = staged(met.select(F.col("doc_id").alias("id")).distinct(), "hit-docs")
    wanted = KeyBitmap(ids, "id")
    texts = docs.filter(wanted.admits("doc_id")).join(ids, docs["doc_id"] == ids["id"], "left_semi")
    doc_tokens = staged(texts.mapInArrow(_tokens, "doc_id long, doc_tokens binary"), "doc-tokens")
    # One row per document and item: the tokens of both meet once, however many diagonals they share. There are
    # fewer diagonals than tokens.
    paired = met.groupBy("doc_id", "item_id").agg(F.collect_list("diagonal").alias("diagonals"))
    verified = (
        paired.join(item_tokens, "item_id").join(doc_tokens, "doc_id")
        .mapInArrow(_verify(plan), "doc_id long, item_id long, doc_start long, doc_end long, words long, equal_words long, item_words long")
    )
    rank = F.struct("equal_words", -F.col("words"), -F.col("doc_start"), "doc_end", "item_words", "words", "doc_start")
    best = verified.groupBy("doc_id", "item_id").agg(F.max(rank).alias("m"))
    return best.select(
        "doc_id", "item_id", *(F.col(f"m.{c}") for c in ("doc_start", "doc_end")), F.col("m")["words"].alias("words"),
        "m.equal_words", "m.item_words", (F.col("m.equal_words") / F.col("m")["words"]).alias("similarity"),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, plan: LeakPlan = LeakPlan(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without a leak, all columns. Rows are told apart by id and text, so NULL ids are judged too."""
    rows = with_row_id(docs, doc_id, text)
    return drop_rows(rows, leaks(rows, benchmark, plan, "_jetloom_row_id", text))
