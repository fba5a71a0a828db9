"""Shared-folder staging and the bounded membership bitmap that several operators use."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jetloom.session import stage_path

#: Bits of a membership bitmap: 8 MB whatever it holds. A fuller bitmap lets more rows through, never fewer.
BITMAP_BITS = 1 << 26


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read again: lineage is cut, copies are reliable."""
    path = stage_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def smallest_by_hash(rows: DataFrame, h: str, n: int, *ties: str) -> DataFrame:
    """The ``n`` rows of smallest BIGINT hash ``h``, ties by the other columns.

    Hashes above a bound that about twice the wanted rows stay below go first, so that the sort behind the limit does not
    bring ``n`` rows of every partition into one task. The bound is widened until enough rows are below it, and does not
    change the result.
    """
    total = rows.count()
    share = (2 * n + 64) / max(total, 1)
    while share < 1:
        below = rows.filter(F.col(h) <= int(-(2.0**63) + share * 2.0**64))
        if below.count() >= n:
            rows = below
            break
        share *= 4
    return rows.orderBy(h, *ties).limit(n)


def with_row_id(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` with a BIGINT ``_jetloom_row_id`` that tells rows apart by id and text.

    It is the id where the id is not NULL and occurs once. Other rows get a number of 2^62 or more from a hash of id and
    text, so rows equal in both share it, and a row with a plain id is the smaller one.
    """
    own = docs[doc_id].cast("long")
    apart = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(own, docs[text]), 2)
    repeated = docs.groupBy(own.alias("_jetloom_again")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1 AND _jetloom_again IS NOT NULL").select("_jetloom_again")
    repeated = staged(repeated, "repeated-ids")
    if repeated.limit(1).count() == 0:
        return docs.withColumn("_jetloom_row_id", F.coalesce(own, apart))
    marked = docs.join(repeated, own == repeated["_jetloom_again"], "left")
    return marked.withColumn("_jetloom_row_id", F.when(own.isNull() | repeated["_jetloom_again"].isNotNull(), apart).otherwise(own)).drop(repeated["_jetloom_again"])


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Of ``docs`` with ``_jetloom_row_id``, one row for each ``_jetloom_row_id`` of ``kept``, without that column."""
    ids = kept.select(F.col("doc_id").alias("_jetloom_row_id")).distinct()
    # The join has dealt and sorted the rows by the column that they are made distinct by.
    return docs.join(ids, "_jetloom_row_id", "left_semi").dropDuplicates(["_jetloom_row_id"]).drop("_jetloom_row_id")


def drop_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` with ``_jetloom_row_id`` but for the rows whose ``_jetloom_row_id`` is in ``dropped``, without that column."""
    ids = dropped.select(F.col("doc_id").alias("_jetloom_row_id")).distinct()
    return docs.join(ids, "_jetloom_row_id", "left_anti").drop("_jetloom_row_id")


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under fixed names, so that extra or clashing columns of the caller never matter.

    ``narrow(df, doc_id="id", text="body")`` reads ``id`` as ``doc_id`` and ``body`` as ``text``.
    """
    return df.select(*(df[source].alias(name) for name, source in columns.items()))


def split_mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (SplitMix64): spreads structured keys over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _slots(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mixed = split_mix(keys.view(np.uint64))
    mask = np.uint64(bits - 1)
    return mixed & mask, (mixed >> np.uint64(32)) & mask


class KeyBitmap:
    """A two-hash Bloom filter of BIGINT keys with a fixed number of bits, built by an aggregation over bitmap words.

    Only the words (``bits / 64`` numbers at most) reach the driver and are broadcast. It admits every key it was
    built from; exact joins follow wherever it is used.
    """

    def __init__(self, keys: DataFrame, column: str, bits: int = BITMAP_BITS):
        self.bits = bits
        words = keys.select(F.col(column).cast("long").alias("key")).mapInArrow(_bit_words(bits), "word long, mask long")
        table = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        content = np.zeros(bits // 64, np.uint64)
        if table.num_rows:
            content[table["word"].to_numpy()] = table["mask"].to_numpy().view(np.uint64)
        self.shared = keys.sparkSession.sparkContext.broadcast(content)

    def admits(self, column: Column | str) -> Column:
        """Boolean column: false only for keys that are certainly absent (and for NULL)."""
        bits, shared = self.bits, self.shared

        @F.pandas_udf("boolean")
        def test(keys):
            import pandas as pd

            present = keys.notna().to_numpy()
            values = keys.fillna(0).to_numpy(dtype=np.int64)
            return pd.Series(probe(shared.value, values, bits) & present)

        return test(F.col(column) if isinstance(column, str) else column)


def probe(words: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Whether each key may be in the bitmap."""
    hit = np.ones(len(keys), bool)
    for slot in _slots(keys, bits):
        hit &= (words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
    return hit


def _bit_words(bits: int):
    def fold(batches):
        for batch in batches:
            keys = batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            slot = np.unique(np.concatenate(_slots(keys, bits)))
            word, start = np.unique(slot >> np.uint64(6), return_index=True)
            mask = np.left_shift(np.uint64(1), slot & np.uint64(63))
            mask = np.bitwise_or.reduceat(mask, start) if len(slot) else mask
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(mask.view(np.int64))], ["word", "mask"])

    return fold


def connected_labels(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """Smallest reachable id of every vertex, as ``(id, component)``.

    ``links(a, b)`` are undirected and touch only ``vertices(id)``. Rounds of taking the neighbours' smallest label and
    then the label's own label; each round is an aggregation over all links, and the loop ends when no label changes,
    after a number of rounds that grows with the logarithm of a chain's length in practice. Nothing is collected
    but the count of changes.
    """
    both = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = staged(vertices.select("id", F.col("id").alias("component")).distinct(), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("id", "b"), "b")
            .groupBy("a").agg(F.min("component").alias("near"))
        )
        hooked = labels.join(near, labels["id"] == near["a"], "left").select(
            "id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component")
        )
        hooked = staged(hooked, "hooked")
        roots = hooked.filter(F.col("id") != F.col("component")).select(F.col("id").alias("root"), F.col("component").alias("above"))
        jumped = hooked.join(roots, hooked["component"] == roots["root"], "left").select(
            "id", "old", F.coalesce("above", "component").alias("component")
        )
        jumped = staged(jumped, "labels")
        labels = jumped.select("id", "component")
        if jumped.filter(F.col("old") != F.col("component")).limit(1).count() == 0:
            return labels


def session_parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
