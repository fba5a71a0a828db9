"""Removal of byte strings that occur more than once anywhere in the corpus, by suffix arrays over shared passages.

Two equal strings of ``length`` bytes hold the same least-hashed ``core`` (half as long) at the same place, so every
repeated string is found among the occurrences of one core. A text's cores are its winnowing minima; cores that occur
once in the corpus are dropped, which leaves shared passages and their surroundings. All occurrences of a core with
their contexts (as many bytes to each side as a string could reach) are sorted by a suffix array built by linear
grouping, in which a suffix's longest repetition is its common prefix with a neighbour. Contexts are cut to the part
they share with another context, and what a whole group shares becomes one symbol.

Equal contexts are one entry with a count, equal texts are one text. A core with more than ``MEMBERS`` different
contexts is split by longer cores (bytes to the left and right of it), down to whole strings if need be, so a task's
group is bounded and exact whatever the number of occurrences. Inside its task a group of more than ``SYMBOLS`` symbols is
taken apart in the same way, one part after the other, so what a suffix array holds is bounded too.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jetloom.llm.lyndon import common_prefixes, suffix_array
from jetloom.llm.staging import KeyBitmap, narrow, staged
from jetloom.llm.text import chunks, prefix_hash, range_hash, text_bytes

#: Different contexts of a core that one group may hold.
MEMBERS = 20_000
#: Symbols that one suffix array may sort: some 70 MB of a task. A group with more is taken apart inside its task.
SYMBOLS = 200_000
#: Splits of the range of window starts: two rounds lead from 201 starts to single ones.
WAYS = 16


@dataclass(frozen=True)
class RepeatPlan:
    """Length of the strings that count as repeated, in bytes; cores take half of it."""

    length: int = 400

    @property
    def core(self) -> int:
        return self.length // 2

    @property
    def reach(self) -> int:
        return self.length - self.core


def sliding(values: np.ndarray, width: int, fold) -> np.ndarray:
    """``fold`` (minimum or maximum) over every run of ``width`` values, by prefix and suffix folds of blocks."""
    n = len(values)
    blocks = -(-n // width)
    filler = np.iinfo(values.dtype).max if fold is np.minimum else np.iinfo(values.dtype).min
    padded = np.full(blocks * width, filler, values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = fold.accumulate(grid, axis=1).ravel()
    behind = fold.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return fold(behind[: n - width + 1], ahead[width - 1 : n])


def cores(prefix: np.ndarray, lo: int, hi: int, plan: RepeatPlan) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the cores of the text ``[lo, hi)``: every core that is least in some whole string around it."""
    if hi - lo < plan.length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    start = np.arange(lo, hi - plan.core + 1)
    hashes = range_hash(prefix, start, start + plan.core)
    width = plan.reach + 1
    least = sliding(hashes, width, np.minimum)
    spread = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)))
    chosen = np.flatnonzero(sliding(spread, width, np.maximum) == hashes)
    return chosen, hashes[chosen]


def _anchors(plan: RepeatPlan):
    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for lo, hi in chunks(offsets):
                base = int(offsets[lo])
                prefix = prefix_hash(data[base : offsets[hi]])
                found = [cores(prefix, int(offsets[d]) - base, int(offsets[d + 1]) - base, plan) for d in range(lo, hi)]
                bounds = np.concatenate(([0], np.cumsum([len(f[0]) for f in found]))).astype(np.int32)
                keys = np.concatenate([f[1] for f in found]).view(np.int64)
                at = np.concatenate([f[0] for f in found]).astype(np.int64)
                cut = pa.StructArray.from_arrays([pa.array(keys), pa.array(at)], ["key", "at"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(bounds), cut)],
                    ["doc_id", "digest", "anchors"],
                )

    return run


def _contexts(plan: RepeatPlan):
    """Contexts of the wanted cores of each text; the same context within a text is one row with its positions."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            rows = []
            for d in range(batch.num_rows):
                raw = data[offsets[d] : offsets[d + 1]].tobytes()
                digest = batch.column(0)[d].as_py()
                own: dict[tuple[int, bytes, bytes], list[int]] = {}
                for anchor in batch.column(2)[d].as_py():
                    at = anchor["at"]
                    left, right = raw[max(0, at - plan.reach) : at], raw[at + plan.core : at + plan.length]
                    own.setdefault((anchor["key"], left, right), []).append(at)
                for (key, left, right), at in own.items():
                    name = hashlib.blake2b(len(left).to_bytes(4, "little") + left + right, digest_size=16).digest()
                    rows.append((key, name, digest, at, left, right))
                if len(rows) > 4000:
                    yield _context_batch(rows)
                    rows = []
            yield _context_batch(rows)

    return run


CONTEXT = "key long, context binary, digest binary, at array<long>, left binary, right binary"


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["key", "context", "digest", "at", "left", "right"]
    )


def _common_with_next(strings: list[bytes]) -> tuple[list[int], np.ndarray]:
    """Sorted order of the strings and the common prefix of each with the next one in it."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    width = max(1, max(map(len, strings)))
    grid = np.zeros((len(strings), width + 1), np.int16)
    for slot, k in enumerate(order):
        own = strings[k]
        grid[slot, : len(own)] = np.frombuffer(own, np.uint8)
        grid[slot, : len(own)] += 1
    alike = (grid[1:] == grid[:-1]) & (grid[1:] > 0)
    return order, alike.argmin(axis=1)


def _longest_shared(order: list[int], lcp: np.ndarray) -> np.ndarray:
    """Of each string the longest prefix that another one has too."""
    out = np.zeros(len(order), np.int64)
    out[order] = np.maximum(np.concatenate((lcp, [0])), np.concatenate(([0], lcp)))
    return out


def _pieces(strings: list[bytes]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Prefixes as runs of pieces: ``(shared by all, ends of the pieces, class of each string (row) up to each end, longest shared)``.

    Two strings that agree beyond one end agree up to the next, so pieces stand for their bytes.
    """
    order, lcp = _common_with_next(strings)
    shared = int(lcp.min())
    ends = np.unique(lcp[lcp > shared])
    classes = np.zeros((len(strings), len(ends)), np.int32)
    classes[order[1:]] = np.cumsum(lcp[:, None] < ends[None, :], axis=0, dtype=np.int32)
    return shared, ends, classes, _longest_shared(order, lcp)


def repeated_starts(lefts: list[bytes], rights: list[bytes], core: int, length: int, most: int | None = None) -> list[tuple[int, int] | None] | None:
    """Per context of a common core: the largest and smallest distance before the core at which a repeated string starts.

    None if the contexts take more than ``most`` symbols.

    A string of ``length`` bytes that starts ``l`` bytes before the core and holds it is repeated when another context
    has the same ``l`` bytes to the left and the same rest to the right.
    """
    need = length - core
    out: list[tuple[int, int] | None] = [None] * len(lefts)
    if len(lefts) < 2:
        return out
    outward = [s[::-1] for s in lefts]
    reach = _longest_shared(*_common_with_next(outward)) + _longest_shared(*_common_with_next(rights))
    open_ = np.flatnonzero(reach >= need).tolist()
    if len(open_) < 2:
        return out
    left_all, left_ends, left_class, left_most = _pieces([outward[k] for k in open_])
    right_all, right_ends, right_class, right_most = _pieces([rights[k] for k in open_])
    n_left = np.searchsorted(left_ends, left_most, side="right")
    n_right = np.searchsorted(right_ends, right_most, side="right")
    # A context is its left pieces, one symbol for the core with what all share around it, its right pieces, an end mark.
    many = len(open_)
    if most is not None and int(n_left.sum() + n_right.sum()) + 2 * many > most:
        return None
    left_class += (np.arange(len(left_ends)) * many).astype(np.int32)
    right_class += ((len(left_ends) + np.arange(len(right_ends))) * many).astype(np.int32)
    middle_symbol = (len(left_ends) + len(right_ends)) * many
    symbols: list[int] = []
    middle: list[int] = []
    for m in range(many):
        symbols += left_class[m, : n_left[m]][::-1].tolist()
        middle.append(len(symbols))
        symbols.append(middle_symbol)
        symbols += right_class[m, : n_right[m]].tolist()
        symbols.append(middle_symbol + 1 + m)
    order = suffix_array(symbols)
    lcp = [*common_prefixes(symbols, order), 0]
    best = [0] * len(symbols)
    for slot, i in enumerate(order):
        best[i] = max(lcp[slot], lcp[slot + 1])
    left_reach, right_reach = [left_all, *left_ends.tolist()], [right_all, *right_ends.tolist()]
    for m, k in enumerate(open_):
        far, near = -1, length
        for pieces in range(int(n_left[m]) + 1):
            same = best[middle[m] - pieces]
            if same <= pieces:
                continue
            # Starts beyond the last but one end, up to this one, meet the same contexts.
            top, rest = left_reach[pieces], right_reach[same - pieces - 1]
            first = max(left_reach[pieces - 1] + 1 if pieces else 0, need - rest)
            if first <= top:
                far, near = max(far, top), min(near, first)
        if far >= 0:
            out[k] = far, near
    return out


SOLVED = "key long, context binary, far long, near long"


def _ranges(lo: int, hi: int) -> list[tuple[int, int]]:
    """``lo`` to ``hi`` in at most ``WAYS`` ranges."""
    width = -(-(hi - lo + 1) // WAYS)
    return [(a, min(hi, a + width - 1)) for a in range(lo, hi + 1, width)]


def solved_group(plan: RepeatPlan, lo: int, hi: int, lefts: list[bytes], rights: list[bytes], members: list[int]) -> list[tuple[int, int, int]]:
    """``(member, far, near)`` of the contexts ``members`` of one core, for strings that start ``lo`` to ``hi`` bytes before it."""
    own: dict[tuple[bytes, bytes], list[int]] = {}
    for m in members:
        # The lengthened core takes ``lo`` bytes of the left and ``reach - hi`` of the right context.
        cut_left = lefts[m][: len(lefts[m]) - lo][-(hi - lo) :] if hi > lo else b""
        own.setdefault((cut_left, rights[m][plan.reach - hi : plan.reach - lo]), []).append(m)
    pairs = list(own)
    core = plan.core + lo + plan.reach - hi
    found = repeated_starts([p[0] for p in pairs], [p[1] for p in pairs], core, plan.length, SYMBOLS if hi > lo else None)
    rows: list[tuple[int, int, int]] = []
    if found is None:
        for a, b in _ranges(lo, hi):
            by_core: dict[tuple[bytes, bytes], list[int]] = {}
            for m in members:
                left, right = lefts[m], rights[m]
                if len(left) >= a and len(right) >= plan.reach - b:
                    by_core.setdefault((left[len(left) - a :], right[: plan.reach - b]), []).append(m)
            for same in by_core.values():
                if len(same) > 1:
                    rows += solved_group(plan, a, b, lefts, rights, same)
        return rows
    for pair, span in zip(pairs, found, strict=True):
        if len(own[pair]) > 1 and len(pair[0]) + len(pair[1]) >= plan.length - core:
            # The same cut context more than once: every string in it is repeated.
            span = len(pair[0]), max(0, plan.length - core - len(pair[1]))
        if span:
            rows += [(m, lo + span[0], lo + span[1]) for m in own[pair]]
    return rows


def _solve(plan: RepeatPlan):
    """One shard: every core's contexts through suffix arrays of their own, core by core."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("lo", "ascending")]).combine_chunks()
        groups = list(zip(table["part"].to_pylist(), table["lo"].to_pylist()))
        at, far, near = [], [], []
        start = 0
        for k in range(1, len(groups) + 1):
            if k < len(groups) and groups[k] == groups[start]:
                continue
            if k - start > 1:
                own = table.slice(start, k - start)
                rows = solved_group(plan, groups[start][1], own["hi"][0].as_py(), own["left"].to_pylist(), own["right"].to_pylist(), list(range(k - start)))
                at += [start + m for m, _, _ in rows]
                far += [f for _, f, _ in rows]
                near += [n for _, _, n in rows]
            start = k
        found = table.select(["key", "context"]).take(pa.array(at, pa.int64()))
        return found.append_column("far", pa.array(far, pa.int64())).append_column("near", pa.array(near, pa.int64()))

    return run


def _split(plan: RepeatPlan):
    """Contexts of crowded cores under longer cores: one row per range of window starts that the context can fill."""

    def run(batches):
        for batch in batches:
            columns = {n: batch.column(k).to_pylist() for k, n in enumerate(batch.schema.names)}
            rows = []
            for k in range(batch.num_rows):
                lo, hi, left, right = (columns[c][k] for c in ("lo", "hi", "left", "right"))
                for a, b in _ranges(lo, hi):
                    if len(left) < a or len(right) < plan.reach - b:
                        continue
                    grown = left[len(left) - a :] + b"|" + right[: plan.reach - b]
                    part = hashlib.blake2b(grown, digest_size=16, key=columns["key"][k].to_bytes(8, "little", signed=True)).digest()
                    rows.append((columns["key"][k], columns["context"][k], left, right, part, a, b))
            kinds = [pa.int64(), *[pa.binary()] * 4, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], batch.schema.names)

    return run


PARTS = "key long, context binary, left binary, right binary, part binary, lo long, hi long"


def _resolve(contexts: DataFrame, plan: RepeatPlan) -> DataFrame:
    """``SOLVED`` of different contexts ``(key, context, left, right)``."""
    todo = contexts.select(
        "key", "context", "left", "right", F.unhex(F.lpad(F.hex("key"), 16, "0")).alias("part"),
        F.lit(0).cast("long").alias("lo"), F.lit(plan.reach).cast("long").alias("hi"),
    )
    solved = []
    while True:
        sizes = todo.groupBy("part", "lo").count()
        single = F.col("hi") == F.col("lo")
        crowded = staged(sizes.filter(F.col("count") > MEMBERS).select("part", F.col("lo").alias("l")), "crowded")
        if crowded.limit(1).count() == 0:
            solved.append(_solve_parts(todo, plan))
            break
        where = [todo["part"] == crowded["part"], todo["lo"] == crowded["l"]]
        # A core as long as the strings needs no order: more than one occurrence is a repetition.
        heavy = todo.join(crowded, where, "left_semi")
        solved.append(heavy.filter(single).select("key", "context", F.col("lo").alias("far"), F.col("lo").alias("near")))
        solved.append(_solve_parts(todo.join(crowded, where, "left_anti"), plan))
        todo = staged(heavy.filter(~single).mapInArrow(_split(plan), PARTS), "split")
        # Alone under the longer core: nothing to compare with.
        shared = todo.groupBy("part", "lo").count().filter("count > 1").drop("count").withColumnRenamed("lo", "l")
        todo = staged(todo.join(shared, (todo["part"] == shared["part"]) & (todo["lo"] == shared["l"]), "left_semi"), "shared")
    out = solved[0]
    for more in solved[1:]:
        out = out.unionByName(more)
    return out.groupBy("key", "context").agg(F.max("far").alias("far"), F.min("near").alias("near"))


def _solve_parts(todo: DataFrame, plan: RepeatPlan) -> DataFrame:
    # Small cores share a group of the shuffle; the shard number follows the table through the partition count.
    shards = 8 * int(todo.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return todo.withColumn("shard", F.pmod(F.xxhash64("part"), F.lit(shards))).groupBy("shard").applyInArrow(_solve(plan), SOLVED)


def _cut(batches):
    """Removed bytes, removed runs and the digest of what is left."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        removed, runs, digests = [], [], []
        for d in range(batch.num_rows):
            raw = data[offsets[d] : offsets[d + 1]].tobytes()
            kept, at, gone, count = hashlib.sha256(), 0, 0, 0
            for start, end in merged(batch.column(2)[d].as_py()):
                kept.update(raw[at:start])
                gone, count, at = gone + end - start, count + 1, end
            kept.update(raw[at:])
            removed.append(gone)
            runs.append(count)
            digests.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests)], ["digest", "n_removed", "n_spans", "kept_sha256"]
        )


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[list[int]] = []
    for span in sorted((s["start"], s["end"]) for s in spans):
        if out and span[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], span[1])
        else:
            out.append(list(span))
    return [tuple(s) for s in out]


class RepeatedStrings:
    """The steps over one table; intermediate tables are staged in the shared folder."""

    def __init__(self, docs: DataFrame, plan: RepeatPlan = RepeatPlan(), doc_id: str = "doc_id", text: str = "text"):
        self.plan = plan
        rows = narrow(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        self.docs = rows.select("doc_id", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest"), "text")
        self.anchored = staged(self.docs.mapInArrow(_anchors(plan), "doc_id long, digest binary, anchors array<struct<key:long,at:long>>"), "anchors")
        # Equal texts are one text; its first document's rows stand for it.
        self.texts = staged(
            self.anchored.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "texts"
        )

    def _wanted(self) -> DataFrame:
        """``(digest, first_id, anchors)``: the cores of each text that occur more than once."""
        firsts = self.texts.select("digest", F.col("first_id").alias("doc_id"))
        once = self.anchored.join(firsts, (self.anchored["digest"] == firsts["digest"]) & self.anchored["doc_id"].eqNullSafe(firsts["doc_id"]), "left_semi")
        once = once.filter(F.size("anchors") > 0).dropDuplicates(["digest"]).select("digest", F.inline("anchors"))
        once = staged(once, "cores")
        shared = once.groupBy("key").count().filter("count > 1").select("key")
        return once.join(shared, "key", "left_semi").groupBy("digest").agg(F.collect_list(F.struct("key", "at")).alias("anchors"))

    def _texts_of(self, table: DataFrame, *columns: str) -> DataFrame:
        """``table(digest, ...)`` with the text of each digest, taken from the first document that holds it."""
        ids = table.join(self.texts, "digest").select("digest", "first_id", *columns)
        wanted = KeyBitmap(ids.filter("first_id IS NOT NULL"), "first_id")
        rows = self.docs.filter(wanted.admits("doc_id") | F.col("doc_id").isNull()).withColumnRenamed("digest", "_digest")
        joined = rows.join(ids, (F.col("_digest") == F.col("digest")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
        return joined.select("digest", "text", *columns)

    def spans(self) -> DataFrame:
        """``(digest, spans)`` of the texts that occur once and lose bytes; spans may overlap."""
        plan = self.plan
        wanted = staged(self._wanted(), "wanted")
        contexts = staged(self._texts_of(wanted, "anchors").mapInArrow(_contexts(plan), CONTEXT), "contexts")
        named = contexts.select("key", "context", "digest", "at")
        kinds = named.groupBy("key", "context").agg(
            F.sum(F.size("at")).alias("uses"), F.min(F.struct("digest", "at")).getField("digest").alias("digest")
        )
        kinds = staged(kinds, "kinds")
        several = staged(kinds.groupBy("key").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("key"), "several")
        bitmap = KeyBitmap(several, "key")
        bytes_ = contexts.filter(bitmap.admits("key")).select("key", "context", "digest", "left", "right")
        different = bytes_.join(kinds.select("key", "context", "digest"), ["key", "context", "digest"], "left_semi").join(several, "key", "left_semi")
        solved = _resolve(staged(different.select("key", "context", "left", "right"), "different"), plan)
        size_left, size_right = F.octet_length("left"), F.octet_length("right")
        # A context met twice is repeated as a whole.
        twice = kinds.filter("uses > 1").select("key", "context", F.lit(True).alias("twice"))
        single = self.texts.filter("copies = 1").select("digest")
        placed = contexts.select("key", "context", "digest", "at", size_left.alias("l"), size_right.alias("r")).join(single, "digest", "left_semi")
        placed = placed.join(solved, ["key", "context"], "left").join(twice, ["key", "context"], "left")
        whole = F.col("twice") & (F.col("l") + F.col("r") >= plan.reach)
        far = F.when(whole, F.col("l")).otherwise(F.col("far"))
        near = F.when(whole, F.greatest(F.lit(0), plan.reach - F.col("r"))).otherwise(F.col("near"))
        span = placed.select("digest", far.cast("long").alias("far"), near.cast("long").alias("near"), F.explode("at").alias("at")).filter("far IS NOT NULL")
        span = span.select("digest", F.struct((F.col("at") - F.col("far")).alias("start"), (F.col("at") - F.col("near") + plan.length).alias("end")).alias("span"))
        return span.groupBy("digest").agg(F.collect_set("span").alias("spans"))

    def removed(self) -> DataFrame:
        """``(digest, n_removed, n_spans, kept_sha256)`` of the texts that occur once and lose bytes."""
        spans = staged(self.spans(), "spans")
        return self._texts_of(spans, "spans").mapInArrow(_cut, "digest binary, n_removed long, n_spans long, kept_sha256 string")


def repeats(docs: DataFrame, plan: RepeatPlan = RepeatPlan(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    A byte goes when a string of ``plan.length`` bytes that covers it also starts elsewhere, in the same document or
    another. NULL is an empty text; texts shorter than ``plan.length`` lose nothing; of texts that occur more than once,
    at least that long, every byte goes in all copies. Rows may repeat an id; other columns are ignored; an empty table
    gives an empty result.
    """
    steps = RepeatedStrings(docs, plan, doc_id, text)
    cut = staged(steps.removed(), "removed")
    sized = steps.docs.select("doc_id", "digest", F.octet_length(F.encode("text", "UTF-8")).cast("long").alias("n_bytes"))
    every = (F.col("copies") > 1) & (F.col("n_bytes") >= plan.length)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    fates = steps.texts.join(cut, "digest", "left").drop("first_id")
    return sized.join(fates, "digest").select(
        "doc_id", "n_bytes",
        F.when(every, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(every, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(every, nothing).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )
