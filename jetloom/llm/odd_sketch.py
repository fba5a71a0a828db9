"""Near duplicates by MinHash bands, verified first by odd sketches and then on the full shingle sets.

**Signature.** ``SAMPLES`` minima of the distinct shingle hashes. A set of about n shingles is hashed by as many
permutations as needed so that each bin of a permutation sees several shingles (long texts need a single one), which
keeps the cost of a document near ``max(n, 16 * SAMPLES)``. Sets of different size classes use different layouts; a set
whose larger partners may lie in the next class is signed in both. An empty bin is a value of its own: two sets then
agree in a bin with a probability of at least their similarity.

**Candidates.** Bands of ``ROWS`` samples; two sets at a threshold of 0.8 share none of the bands once in 7 million
times. Every member of a band bucket meets the bucket's smallest id, which is linear in the bucket. Buckets whose members did not
all end in one component are searched again, pair by pair in blocks of bounded size, between different components only.

**Odd sketch.** The (sample, value) pairs of a signature flip bits of a 512-bit parity map. Equal samples cancel in the
XOR of two maps, so its population count estimates the number of differing samples: precise for high similarities.
Candidates whose estimate lies more than five standard deviations below the threshold end here.

**Confirmation** compares the full sets of 64-bit shingle hashes. Equal sets are one class before any of this and need no pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jetloom.llm.staging import KeyBitmap, connected_labels, keep_rows, narrow, split_mix, staged, with_row_id
from jetloom.llm.text import chunks, distinct_shingles, text_bytes, words_of

ROWS = 5
BANDS = 40
SAMPLES = ROWS * BANDS
SKETCH_BITS = 512
SKETCH_WORDS = SKETCH_BITS // 64
#: (smallest set size, bins per permutation): at least four shingles a bin from the second class on.
CLASSES = ((1, 1), (16, 4), (80, 20), (200, 50), (800, 200))
#: Members compared with each other in one task of the second search.
BLOCK = 512


@dataclass(frozen=True)
class NearPlan:
    """Shingle width and the link rule ``100 * intersection >= percent * union``."""

    width: int = 5
    percent: int = 80


#: The contract of the registered query ``op4_odd_sketch_dedup``.
QUERY_PLAN = NearPlan(percent=85)


def size_classes(n: int, percent: int) -> list[int]:
    """Layouts a set of ``n`` shingles is signed in: its own, and the next one if a partner may be there."""
    own = max(k for k, (least, _) in enumerate(CLASSES) if n >= least)
    largest = n * 100 // percent
    return [own, own + 1] if own + 1 < len(CLASSES) and largest >= CLASSES[own + 1][0] else [own]


def minhash(shingles: np.ndarray, layout: int) -> np.ndarray:
    """``SAMPLES`` minima of the distinct shingle hashes; an empty bin holds the largest value."""
    bins = CLASSES[layout][1]
    out = np.full((SAMPLES // bins, bins), np.iinfo(np.uint64).max, np.uint64)
    for k in range(len(out)):
        # Tag permutations by layout so that classes never share a value by accident.
        mixed = (shingles ^ np.uint64(0xA0761D6478BD642F * (k + 1 + 1000 * layout) % (1 << 64))) * np.uint64(0x9FB21C651E98DF25)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        if bins == 1:
            out[k, 0] = mixed.min()
            continue
        # The bin is the leading part of the hash, so sorting brings every bin's minimum to its front.
        mixed.sort()
        place = ((mixed >> np.uint64(40)) * np.uint64(bins) >> np.uint64(24)).astype(np.intp)
        front = np.flatnonzero(place[1:] != place[:-1]) + 1
        out[k, place[0]] = mixed[0]
        out[k, place[front]] = mixed[front]
    return out.ravel()


def band_keys(samples: np.ndarray, layouts: np.ndarray) -> np.ndarray:
    """One 64-bit key per band and row of the table of samples."""
    grid = samples.reshape(-1, BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] + (1 + BANDS * layouts.astype(np.uint64))[:, None]
    for r in range(ROWS):
        key = split_mix(key ^ grid[:, :, r]) + np.uint64(r)
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the numbered samples of every row, as 64-bit words."""
    n = len(samples)
    spot = split_mix(samples + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SKETCH_BITS)
    spot = spot.astype(np.int64) + np.arange(n)[:, None] * SKETCH_BITS
    odd = np.bincount(spot.ravel(), minlength=n * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).reshape(n, SKETCH_WORDS)


def most_differing(percent: int) -> int:
    """XOR population above which a pair at the threshold is out of the question (5.3 standard deviations).

    With m samples of which d differ, about ``SKETCH_BITS * (1 - exp(-4d / SKETCH_BITS)) / 2`` bits stay set. The
    deviation is that of d and that of the bits on which 2d entries fall.
    """
    similar = percent / 100
    differing = SAMPLES * (1 - similar)
    fade = np.exp(-4 * differing / SKETCH_BITS)
    of_samples = 4 * fade**2 * differing * similar
    of_bits = SKETCH_BITS * (1 - fade**2) / 4 - 2 * differing * fade**2
    return int(np.ceil(SKETCH_BITS * (1 - fade) / 2 + 5.3 * np.sqrt(of_samples + max(of_bits, 0.0))))


def estimated_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets from their odd sketches."""
    share = min(int(np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum()) / SKETCH_BITS, 0.4999)
    return float(1 + SKETCH_BITS * np.log(1 - 2 * share) / (4 * SAMPLES))


SIGNATURE = (
    "doc_id long, n_shingles long, set_a long, set_b long, "
    "signatures array<struct<layout:int,bands:array<long>,sketch:array<long>>>"
)


def _lists(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, max(width, 1))[: n + 1], pa.int32()), pa.array(rows.ravel()))


def _sign(plan: NearPlan):
    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in chunks(offsets):
                words = words_of(data, offsets[lo : hi + 1])
                size = np.zeros(hi - lo, np.int64)
                identity = np.zeros((hi - lo, 2), np.uint64)
                counts, layouts, samples = [0], [], []
                for d in range(hi - lo):
                    shingles = distinct_shingles(words, d, plan.width)
                    size[d] = n = len(shingles)
                    if n:
                        mixed = split_mix(shingles)
                        identity[d] = mixed.sum(dtype=np.uint64) + np.uint64(n), np.bitwise_xor.reduce(mixed * (mixed | np.uint64(1)))
                        for layout in size_classes(n, plan.percent):
                            layouts.append(layout)
                            samples.append(minhash(shingles, layout))
                    counts.append(len(layouts))
                table = np.array(samples, np.uint64).reshape(-1, SAMPLES)
                kinds = np.array(layouts, np.int32)
                signed = pa.StructArray.from_arrays(
                    [pa.array(kinds), _lists(band_keys(table, kinds)), _lists(odd_sketch(table))], ["layout", "bands", "sketch"]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), pa.array(size),
                        *(pa.array(identity[:, k].view(np.int64), mask=size == 0) for k in range(2)),
                        pa.ListArray.from_arrays(pa.array(counts, pa.int32()), signed),
                    ],
                    ["doc_id", "n_shingles", "set_a", "set_b", "signatures"],
                )

    return run


def _shingle_sets(plan: NearPlan):
    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in chunks(offsets):
                words = words_of(data, offsets[lo : hi + 1])
                sets = [distinct_shingles(words, d, plan.width) for d in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "shingles"]
                )

    return run


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """The link rule on two sorted sets."""
    both = np.concatenate((x, y))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _confirm(percent: int):
    """Pairs whose full sets satisfy the link rule."""

    def run(batches):
        for batch in batches:
            a, b, left, right = batch.columns
            good = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                good[k] = linked(*(np.frombuffer(c[k].as_buffer(), np.uint64) for c in (left, right)), percent)
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    return run


def _differing(left: str, right: str) -> Column:
    """XOR population count of two sketch arrays."""
    total = F.lit(0)
    for k in range(SKETCH_WORDS):
        total = total + F.bit_count(F.col(left)[k].bitwiseXOR(F.col(right)[k]))
    return total


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _search_block(percent: int):
    """Links between different components of the two sides of a block, as many as it takes to join them.

    A pair is looked at in the first band that its two members share and only while no link found here has joined
    them, so a block returns fewer links than it has members.
    """
    most = most_differing(percent)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, comp, n, side = (table[c].to_numpy() for c in ("id", "component", "n", "side"))
        band = table["band"][0].as_py()
        rows = len(ids)
        matrix = lambda c, w: table[c].combine_chunks().flatten().to_numpy().reshape(rows, w)
        sketch, bands = matrix("sketch", SKETCH_WORDS).view(np.uint64), matrix("bands", BANDS)
        shingles = table["shingles"].combine_chunks()
        own_band = int(np.flatnonzero(bands[0] == band)[0])
        right = np.flatnonzero(side >= 1)
        parent = {int(c): int(c) for c in np.unique(comp)}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        found: list[tuple[int, int]] = []
        for k in np.flatnonzero(side <= 1):
            at = right[right > k] if side[k] == 1 else right
            at = at[(comp[at] != comp[k]) & (100 * np.minimum(n[at], n[k]) >= percent * np.maximum(n[at], n[k]))]
            at = at[np.bitwise_count(sketch[at] ^ sketch[k]).sum(axis=1) <= most]
            at = at[~(bands[at, :own_band] == bands[k, :own_band]).any(axis=1)]
            if len(at):
                mine = np.frombuffer(shingles[int(k)].as_buffer(), np.uint64)
            for m in at:
                here, there = root(int(comp[k])), root(int(comp[m]))
                if here != there and linked(mine, np.frombuffer(shingles[int(m)].as_buffer(), np.uint64), percent):
                    parent[max(here, there)] = min(here, there)
                    found.append((int(ids[k]), int(ids[m])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return run


class NearDuplicates:
    """The steps of the search over one table; every step is staged in the shared folder."""

    def __init__(self, docs: DataFrame, plan: NearPlan = NearPlan(), doc_id: str = "doc_id", text: str = "text"):
        self.plan = plan
        self.docs = narrow(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.signed = staged(self.docs.mapInArrow(_sign(plan), SIGNATURE), "signatures")
        filled = self.signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        self.classes = staged(filled.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("id")), "classes")

    def representatives(self) -> DataFrame:
        """``(id, n, layout, bands, sketch)`` of the smallest document of every set of shingles, a row per layout."""
        firsts = self.classes.select(F.col("id").alias("doc_id"), "set_a", "set_b")
        # The class's own set tells the rows apart where an id repeats with different texts.
        rows = self.signed.join(firsts, ["doc_id", "set_a", "set_b"], "left_semi").dropDuplicates(["doc_id", "set_a", "set_b"])
        return rows.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.inline("signatures"))

    def _promising(self, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        """Pairs whose sizes and odd sketches allow a link."""
        a = sketches.select(F.col("id").alias("a"), "layout", F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
        b = sketches.select(F.col("id").alias("b"), "layout", F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
        return (
            pairs.join(a, ["a", "layout"]).join(b, ["b", "layout"])
            .filter(_sizes_fit(F.col("n_a"), F.col("n_b"), self.plan.percent))
            .filter(_differing("sketch_a", "sketch_b") <= most_differing(self.plan.percent))
            .select("a", "b").distinct()
        )

    def _shingles(self, ids: DataFrame) -> DataFrame:
        """``(id, shingles)`` of the given ids; only their texts are shingled again."""
        wanted = KeyBitmap(ids, "id")
        texts = self.docs.filter(wanted.admits("doc_id")).join(ids, F.col("doc_id") == F.col("id"), "left_semi")
        return staged(texts.mapInArrow(_shingle_sets(self.plan), "id long, shingles binary").dropDuplicates(["id"]), "shingles")

    def _confirmed(self, pairs: DataFrame) -> DataFrame:
        """Pairs that satisfy the link rule on full sets."""
        sets = self._shingles(staged(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "paired"))
        return (
            pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("right")), "b")
            .join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("left")), "a")
            .select("a", "b", "left", "right")
            .mapInArrow(_confirm(self.plan.percent), "a long, b long")
        )

    def links(self) -> tuple[DataFrame, DataFrame]:
        """``(labels, links)``: a first component of every representative, and links that complete the components."""
        reps = staged(self.representatives(), "representatives")
        bands = reps.select("id", F.col("layout").cast("byte").alias("layout"), F.explode("bands").alias("band"))
        shared = bands.groupBy("band").agg(F.min("id").alias("pivot"), F.count("*").alias("members")).filter("members > 1")
        met = staged(bands.join(shared, "band").filter("id != pivot"), "buckets")
        first = met.select(F.col("id").alias("a"), F.col("pivot").alias("b"), "layout").distinct()
        links = staged(self._confirmed(staged(self._promising(first, reps), "promising")), "confirmed")
        labels = connected_labels(reps.select("id").distinct(), links)
        return labels, self._between_components(met, labels, reps)

    def _between_components(self, met: DataFrame, labels: DataFrame, reps: DataFrame) -> DataFrame:
        """Links among bucket members that the pivots left in different components.

        Pairs with the pivot are settled already. A bucket of many members is cut into blocks by id hash and every pair
        of blocks is one group, so a group holds two blocks whatever the bucket's size.
        """
        open_ = met.filter("members > 2").join(labels, "id").select("band", "layout", "id", "component", "members")
        torn = open_.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("band")
        rows = staged(open_.join(torn, "band", "left_semi"), "torn")
        sets = self._shingles(staged(rows.select("id").distinct(), "torn-ids"))
        blocks = F.ceil(F.col("members") / BLOCK)
        own = F.pmod(F.xxhash64("id", F.lit("block")), blocks)
        dealt = rows.withColumns({"blocks": blocks, "own": own}).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        dealt = dealt.join(reps, ["id", "layout"]).join(sets, "id").select(
            "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            F.when(F.col("own") == F.col("other"), 1).when(F.col("own") < F.col("other"), 0).otherwise(2).alias("side"),
            "id", "component", "n", "sketch", "bands", "shingles",
        )
        return staged(dealt.groupBy("band", "i", "j").applyInArrow(_search_block(self.plan.percent), "a long, b long"), "between")

    def components(self) -> DataFrame:
        """``(doc_id, n_shingles, component_id, kept)`` of every document."""
        labels, links = self.links()
        # The links run between documents of known components: join those components.
        ends = links.join(labels.select(F.col("id").alias("a"), F.col("component").alias("c")), "a").join(
            labels.select(F.col("id").alias("b"), F.col("component").alias("d")), "b"
        ).select(F.col("c").alias("a"), F.col("d").alias("b"))
        merged = connected_labels(ends.select(F.col("a").alias("id")).union(ends.select("b")).distinct(), ends)
        above = merged.select(F.col("id").alias("component"), F.col("component").alias("top"))
        final = labels.join(above, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
        named = self.classes.join(final, "id").select("set_a", "set_b", "component")
        component = F.coalesce("component", "doc_id")
        return self.signed.select("doc_id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"], "left").select(
            "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept")
        )


def near_components(docs: DataFrame, plan: NearPlan = QUERY_PLAN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``; by default under the rule of the registered query.

    ``n_shingles`` is the size of the set of distinct runs of ``width`` lower-cased words (a shorter text is one run).
    NULL, empty and wordless texts have none and link with nothing. A NULL id is never linked or kept; rows that repeat an id are one document in the
    result's component if their texts agree. Other columns are ignored; an empty table gives an empty result.
    """
    return NearDuplicates(docs, plan, doc_id, text).components()


def keep_smallest(docs: DataFrame, plan: NearPlan = NearPlan(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, all columns; by default components at the general 80 percent.

    Rows are told apart by id and text, as in ``cuckoo.keep_first``; texts without words all stay, once an id.
    """
    rows = with_row_id(docs, doc_id, text)
    return keep_rows(rows, near_components(rows, plan, "_jetloom_row_id", text).filter("kept"))
