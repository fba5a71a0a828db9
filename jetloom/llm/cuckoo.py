"""Exact duplicates through a sharded cuckoo-filter index of text digests.

Texts are equal when they agree after every run of ASCII white space became one space; a NULL text counts as empty, so
NULL and empty texts form one group. A digest's shard is chosen by its first bytes. Every shard keeps a cuckoo filter
(16-bit fingerprints, four slots a bucket) beside a content store bucketed like the filter: the filter answers most
absent digests, a hit is verified against the full digests stored under its bucket, and when an insertion finds no free
slot after ``MAX_KICKS`` moves the table doubles and is filled again from the stored digests.

Groups of any size are safe: scan tasks merge their own copies first, so one digest reaches its shard at most once per
``COMBINE_ROWS`` rows of a task, and copies are matched to their group by a join that adaptive execution can split.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jetloom.llm.staging import keep_rows, narrow, staged, with_row_id
from jetloom.llm.text import SPACE_REGEX

SLOTS = 4
MAX_KICKS = 200
#: Distinct digests a scan task holds while merging its own copies.
COMBINE_ROWS = 50_000
#: Digest rows a shard should hold; the number of shards follows the table.
SHARD_ROWS = 20_000


class CuckooIndex:
    """Filter and bucketed content of one shard: digest -> [smallest live id, live count].

    ``add`` merges a digest in, ``remove`` takes live copies away and drops the digest with its last copy, ``get`` looks
    a digest up. False hits of the filter never show: the stored digests decide.
    """

    def __init__(self, capacity: int = 64):
        self._allocate(capacity)
        self.content: dict[int, dict[bytes, list[int]]] = {}
        self.size = self.hits = self.false_hits = self.resizes = 0

    def _allocate(self, capacity: int) -> None:
        self.buckets = 1 << max(4, int(np.ceil(capacity / SLOTS / 0.9)).bit_length())
        self.table = [0] * (self.buckets * SLOTS)

    @staticmethod
    def _key(digest: bytes) -> tuple[int, int]:
        """Content bucket and non-zero fingerprint of a digest; its leading bytes already chose the shard."""
        return int.from_bytes(digest[8:16], "little"), (int.from_bytes(digest[16:18], "little") or 1)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        home, mark = self._key(digest)
        first = home & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def may_hold(self, digest: bytes) -> bool:
        """The filter's answer: false means certainly absent."""
        mark, a, b = self._places(digest)
        table = self.table
        return mark in table[a * SLOTS : a * SLOTS + SLOTS] or mark in table[b * SLOTS : b * SLOTS + SLOTS]

    def get(self, digest: bytes) -> list[int] | None:
        """Verified lookup: ``[smallest live id, live count]`` or None."""
        if not self.may_hold(digest):
            return None
        found = self.content.get(self._key(digest)[0], {}).get(digest)
        self.hits += 1
        self.false_hits += found is None
        return found

    def add(self, digest: bytes, smallest: int, count: int) -> None:
        entry = self.get(digest)
        if entry is not None:
            entry[0] = min(entry[0], smallest)
            entry[1] += count
            return
        self.content.setdefault(self._key(digest)[0], {})[digest] = [smallest, count]
        self.size += 1
        if not self._place(digest):
            self._grow()

    def remove(self, digest: bytes, count: int) -> bool:
        """Take ``count`` live copies away; true when the digest itself left the index."""
        entry = self.get(digest)
        if entry is None:
            raise KeyError("digest is not in the index")
        entry[1] -= count
        if entry[1] > 0:
            return False
        home = self._key(digest)[0]
        del self.content[home][digest]
        if not self.content[home]:
            del self.content[home]
        mark, a, b = self._places(digest)
        for bucket in (a, b):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.table[slot] == mark:
                    self.table[slot] = 0
                    self.size -= 1
                    return True
        raise AssertionError("filter and content disagree")

    def _place(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        table = self.table
        for bucket in (a, b):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if table[slot] == 0:
                    table[slot] = mark
                    return True
        bucket = a
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + (mark + kick) % SLOTS
            mark, table[slot] = table[slot], mark
            bucket = self._other(bucket, mark)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if table[slot] == 0:
                    table[slot] = mark
                    return True
        return False

    def _grow(self) -> None:
        """Overflow: a larger table, filled from the stored digests."""
        capacity = self.buckets * SLOTS
        while True:
            capacity *= 2
            self._allocate(capacity)
            self.resizes += 1
            if all(self._place(d) for bucket in self.content.values() for d in bucket):
                return

    def entries(self) -> list[tuple[bytes, int, int]]:
        return [(d, e[0], e[1]) for bucket in self.content.values() for d, e in bucket.items()]


def normalised(text: Column) -> Column:
    """The text that equality is decided on."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_REGEX, " ")


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, lowercase hex."""
    return F.sha2(F.encode(normalised(text), "UTF-8"), 256)


def _merge_within_task(batches):
    """Map-side: each task's own copies of a digest become one row."""

    def flush(held: CuckooIndex) -> pa.RecordBatch:
        rows = held.entries()
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
            ["digest", "smallest", "copies"],
        )

    held = CuckooIndex(COMBINE_ROWS)
    for batch in batches:
        for digest, smallest, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.add(digest, smallest, copies)
            if held.size >= COMBINE_ROWS:
                yield flush(held)
                held = CuckooIndex(COMBINE_ROWS)
    if held.size:
        yield flush(held)


def _merge_shard(table: pa.Table) -> pa.Table:
    """One shard: every partial row goes through the index; one row per digest comes out."""
    index = CuckooIndex(table.num_rows)
    columns = (table[c].to_pylist() for c in ("digest", "smallest", "copies"))
    for digest, smallest, copies in zip(*columns, strict=True):
        index.add(digest, smallest, copies)
    rows = index.entries()
    return pa.table({
        "digest": pa.array([r[0] for r in rows], pa.binary()),
        "keep_id": pa.array([r[1] for r in rows], pa.int64()),
        "group_size": pa.array([r[2] for r in rows], pa.int64()),
    })


def _shard(digest: Column, shards: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring(digest, 1, 6)), 16, 10).cast("long"), F.lit(shards))


def build_index(digests: DataFrame, shards: int) -> DataFrame:
    """``(digest, keep_id, group_size)`` of all rows ``(digest, doc_id)``, one row per live digest."""
    single = digests.select("digest", F.col("doc_id").alias("smallest"), F.lit(1).cast("long").alias("copies"))
    partial = single.mapInArrow(_merge_within_task, "digest binary, smallest long, copies long")
    return (
        partial.withColumn("shard", _shard(F.col("digest"), shards))
        .groupBy("shard")
        .applyInArrow(_merge_shard, "digest binary, keep_id long, group_size long")
    )


def update_index(index: DataFrame, added: DataFrame, removed: DataFrame, shards: int) -> DataFrame:
    """The index after insertions and deletions.

    ``index(digest, keep_id, group_size)``; ``added(digest, doc_id)``; ``removed(digest, copies)``. A digest whose last
    live copy goes leaves the index; removing an unknown digest fails the job. After a removal ``keep_id`` stays the
    smallest id ever inserted since the digest was last absent.
    """
    plus = (
        added.select("digest", F.col("doc_id").alias("smallest"), F.lit(1).cast("long").alias("copies"))
        .mapInArrow(_merge_within_task, "digest binary, smallest long, copies long")
    )
    minus = removed.groupBy("digest").agg((-F.sum("copies")).alias("copies"))
    changes = plus.unionByName(minus.select("digest", F.lit(None).cast("long").alias("smallest"), "copies"))
    held = index.select("digest", F.col("keep_id").alias("smallest"), F.col("group_size").alias("copies"))

    def apply(table: pa.Table) -> pa.Table:
        shard = CuckooIndex(table.num_rows)
        rows = list(zip(*(table[c].to_pylist() for c in ("digest", "smallest", "copies")), strict=True))
        for digest, smallest, copies in rows:
            if copies > 0:
                shard.add(digest, smallest, copies)
        for digest, _, copies in rows:
            if copies < 0:
                shard.remove(digest, -copies)
        left = shard.entries()
        return pa.table({
            "digest": pa.array([r[0] for r in left], pa.binary()),
            "keep_id": pa.array([r[1] for r in left], pa.int64()),
            "group_size": pa.array([r[2] for r in left], pa.int64()),
        })

    return (
        held.unionByName(changes)
        .withColumn("shard", _shard(F.col("digest"), shards))
        .groupBy("shard")
        .applyInArrow(apply, "digest binary, keep_id long, group_size long")
    )


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the smallest id stays. Rows that repeat an id with equal text are both ``kept`` (they are
    the same document); a NULL id is never kept and yields to any other. An empty table gives an empty result. Other columns are ignored.
    """
    rows = narrow(docs, doc_id=doc_id, text=text).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.unhex(text_digest(F.col("text"))).alias("digest")
    )
    rows = staged(rows, "digests")
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    known = rows.select("digest", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"))
    groups = build_index(known, shards)
    return rows.join(groups, "digest").select(
        "doc_id",
        F.when(F.col("keep_id") < (1 << 63) - 1, F.col("keep_id")).alias("keep_id"),
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of every text, all columns: the one of smallest id.

    Rows are told apart by id and text, so a NULL or repeated id neither saves nor loses a text; a row whose id is NULL
    or repeated yields to one with an id of its own. Which of several rows equal in id and text stays is open.
    """
    rows = with_row_id(docs, doc_id, text)
    return keep_rows(rows, exact_groups(rows, "_jetloom_row_id", text).filter("kept"))
