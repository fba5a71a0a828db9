"""Mixing sources to target weights by cube-method balanced sampling.

Every source gets a target size from its weight. A document is repeated ``floor(r)`` times, ``r`` being its source's
target over its size, and once more with the fractional part of ``r`` as inclusion probability. Which documents get the
extra copy is decided by the cube method: a flight moves the probabilities of three undecided documents along the null
space of the two balancing constraints (document total, token total) until one of them becomes 0 or 1, so both totals
of the sample stay exactly what they were. A flight leaves at most two undecided documents; flights run in blocks of
bounded size, the undecided of all blocks fly again together, and so on until a single block per source is left, whose
two documents are landed: the document constraint is dropped, then a keyed coin decides the last one.

Blocks are keyed by hashes of the id, never by input partitions, so reruns agree under any partitioning.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jetloom.llm.staging import narrow, staged
from jetloom.llm.text import WORD_REGEX

#: Documents that fly together; a round shrinks the undecided by half of it.
BLOCK_ROWS = 20_000
#: Longest documents of a block that are settled against all others of it.
LONG = 256
EPS = 1e-9


@dataclass(frozen=True)
class MixPlan:
    """Weights repeat over the sources in code point order (NULL last)."""

    weights: tuple[float, ...] = (1.0, 2.0, 3.0)
    share: float = 1.0
    max_repeat: int = 3
    seed: int = 17


def size_in_words(text: Column) -> Column:
    """Words of a text; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, plan: MixPlan) -> DataFrame:
    """``(source, source_size, weight, target, full)`` of the table ``(source, size)``.

    Targets are the weighted shares of ``plan.share`` of everything; a source that would pass ``max_repeat`` times its
    size stops there and the excess is dealt again by weight. The table has a row per source; ranks follow from the
    sizes of value ranges, so no task sees more than a range.
    """
    totals = staged(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("key", F.encode("source", "UTF-8")), "sources"
    )
    # Code point order is the order of the UTF-8 bytes.
    ranged = staged(
        totals.repartitionByRange(F.col("key").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "ranged"
    )
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offset = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(W.partitionBy("part").orderBy(F.col("key").asc_nulls_last())) - 1
    rank = F.col("offset") + F.col("within")
    weights = F.array(*(F.lit(float(w)) for w in plan.weights))
    ranked = staged(
        ranged.withColumn("within", within).join(offset, "part")
        .select("source", "source_size", F.get(weights, (rank % len(plan.weights)).cast("int")).alias("weight")),
        "weights",
    )
    everything = ranked.agg(F.sum("source_size")).first()[0] or 0
    limit = plan.max_repeat * F.col("source_size")
    # Water filling: the level only rises, and every pass caps at least one more source or ends.
    level, capped = 0.0, -1
    while True:
        full = limit <= F.lit(level) * F.col("weight")
        n, held, open_weight = ranked.agg(
            F.count_if(full), F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if n == capped or not open_weight:
            break
        capped = n
        level = max(level, (plan.share * everything - (held or 0)) / open_weight)
    full = limit <= F.lit(level) * F.col("weight")
    target = F.when(full, limit.cast("double")).otherwise(F.lit(float(level)) * F.col("weight"))
    return ranked.select("source", "source_size", "weight", target.alias("target"), full.alias("full"))


def fly(size: np.ndarray, chance: np.ndarray, coin: np.ndarray) -> np.ndarray:
    """Flight phase over one block: probabilities after which at most two lie strictly between 0 and 1.

    Both ``sum(chance)`` and ``sum(size * chance)`` are kept (up to rounding). A move goes to either end with the odds
    that keep every probability a martingale; ``coin`` of the document that completed the three decides.
    """
    value = chance.astype(float).tolist()
    weight = size.astype(float).tolist()
    coins = coin.tolist()
    pool: list[int] = []
    for i, p in enumerate(value):
        if p <= EPS or p >= 1 - EPS:
            continue
        pool.append(i)
        while len(pool) == 3:
            a, b, c = pool
            # Null vector of the rows (1, 1, 1) and (sizes): their cross product.
            step = (weight[c] - weight[b], weight[a] - weight[c], weight[b] - weight[a])
            _move(value, pool, step if any(step) else (1.0, -1.0, 0.0), coins[i])
            pool = [k for k in pool if 0.0 < value[k] < 1.0]
    return np.array(value)


def fly_long(size: np.ndarray, chance: np.ndarray, coin: np.ndarray, count: int = LONG) -> np.ndarray:
    """Settle the ``count`` longest documents first, each along a null-space direction spread over all others.

    Three-document moves cannot settle a document much longer than its companions, and it would be left for the
    landing. Here the change of the long document is made up by a little of every other undecided one.
    """
    value = chance.astype(float)
    weight = size.astype(float)
    order = np.argsort(-weight, kind="stable")
    for a in order[:count]:
        turn = 0
        while EPS < value[a] < 1 - EPS:
            rest = np.flatnonzero((value > EPS) & (value < 1 - EPS))
            rest = rest[rest != a]
            s0, s1, s2 = len(rest), weight[rest].sum(), (weight[rest] ** 2).sum()
            det = s0 * s2 - s1 * s1
            if s0 < 2 or det <= 1e-9 * max(1.0, s0 * s2):
                break
            step = ((s1 * weight[a] - s2) + (s1 - s0 * weight[a]) * weight[rest]) / det
            with np.errstate(divide="ignore"):
                to_one, to_zero = (1 - value[rest]) / np.abs(step), value[rest] / np.abs(step)
            rising = step > 0
            up = min(1 - value[a], np.where(rising, to_one, to_zero).min())
            down = min(value[a], np.where(rising, to_zero, to_one).min())
            luck = coin[a] if turn == 0 else coin[rest[turn % s0]]
            move = up if luck * (up + down) < down else -down
            value[a] += move
            value[rest] += move * step
            value[value < EPS] = 0.0
            value[value > 1 - EPS] = 1.0
            turn += 1
    return value


def _move(value: list[float], pool, step, coin: float) -> None:
    """Move along ``step`` until a probability reaches 0 or 1."""
    up = down = float("inf")
    for k, s in zip(pool, step, strict=True):
        if s > 0:
            up, down = min(up, (1 - value[k]) / s), min(down, value[k] / s)
        elif s < 0:
            up, down = min(up, value[k] / -s), min(down, (1 - value[k]) / -s)
    move = up if coin * (up + down) < down else -down
    for k, s in zip(pool, step, strict=True):
        moved = value[k] + move * s
        value[k] = 0.0 if moved < EPS else 1.0 if moved > 1 - EPS else moved


def land(size: np.ndarray, chance: np.ndarray, coin: np.ndarray, luck: np.ndarray) -> np.ndarray:
    """Landing of at most two documents: a last move that keeps the token total, then ``luck`` decides the one left."""
    value = chance.astype(float).tolist()
    open_ = [k for k, p in enumerate(value) if EPS < p < 1 - EPS]
    if len(open_) == 2:
        a, b = open_
        _move(value, open_, (float(size[b]), -float(size[a])) if size[a] or size[b] else (1.0, -1.0), float(coin[a]))
    value = np.array(value)
    return (value > 1 - EPS) | ((value > EPS) & (luck < value))


def _fly_block(rows: pd.DataFrame) -> pd.DataFrame:
    # Long documents first: what stays undecided at the end of a block is short.
    rows = rows.sort_values(["size", "coin", "row"], ascending=[False, True, True])
    size, coin = rows["size"].to_numpy(), rows["coin"].to_numpy()
    rows["chance"] = fly(size, fly_long(size, rows["chance"].to_numpy(), coin), coin)
    return rows[STATE_COLUMNS]


def _land_block(rows: pd.DataFrame) -> pd.DataFrame:
    rows = _fly_block(rows).assign(luck=rows["luck"])
    size, chance, coin, luck = (rows[c].to_numpy() for c in ("size", "chance", "coin", "luck"))
    rows["chance"] = land(size, chance, coin, luck).astype(float)
    return rows[STATE_COLUMNS]


def _uniform(*key) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(1 << 53)) / F.lit(float(1 << 53))


STATE = "row string, source string, size long, chance double, coin double, bucket long"
STATE_COLUMNS = ["row", "source", "size", "chance", "coin", "bucket"]


def balanced_sample(units: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Cube-method sample of ``units(row, source, size, chance, bucket)``: the same rows with ``chance`` 0 or 1.

    ``bucket`` is a uniform hash of the row, from which every round draws fresh coins. Each source keeps its document
    and token totals up to its one landing.
    """
    decided: list[DataFrame] = []
    for flight in itertools.count():
        counts = units.groupBy("source").agg(F.count("*").alias("n"))
        largest = counts.agg(F.max("n")).first()[0]
        blocks = counts.select(F.col("source").alias("_s"), F.ceil(F.col("n") / block_rows).alias("blocks"))
        # One row per source against all rows: a plain join that adaptive execution may turn round.
        dealt = units.join(blocks, units["source"].eqNullSafe(blocks["_s"]))
        dealt = dealt.withColumns({
            "block": F.pmod(F.xxhash64("bucket", F.lit(-1)), "blocks"),
            "coin": _uniform("bucket", F.lit(flight)),
            "luck": _uniform("bucket", F.lit(-2)),
        })
        last = largest is None or largest <= block_rows
        flown = dealt.groupBy("source", "block").applyInPandas(_land_block if last else _fly_block, STATE)
        if last:
            decided.append(flown)
            break
        flown = staged(flown, "flight")
        open_ = (F.col("chance") > EPS) & (F.col("chance") < 1 - EPS)
        decided.append(flown.filter(~open_))
        units = flown.filter(open_)
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out


def mix(docs: DataFrame, plan: MixPlan = MixPlan(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies, taken``.

    ``copies`` is how often the mix repeats the document (0 to ``max_repeat``), ``taken = copies * size``. NULL text has
    size 0, a NULL source is a source of its own, rows that repeat an id are told apart by a serial number among equal
    ``(id, source, size)`` rows. Empty tables give empty results; other columns are ignored.
    """
    rows = narrow(docs, doc_id=doc_id, text=text, source=source).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_in_words(F.col("text")).alias("size")
    )
    # Equal rows collapse to a count and come back numbered, so that each has a key of its own.
    rows = (
        rows.groupBy("doc_id", "source", "size").count()
        .select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("serial"))
    )
    rows = staged(rows, "sizes")
    targets = staged(source_targets(rows, plan), "targets")
    ratio = F.when(F.col("full"), F.lit(float(plan.max_repeat))).otherwise(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "serial", "size")
    joined = (
        rows.join(targets.withColumnRenamed("source", "_t"), rows["source"].eqNullSafe(F.col("_t")))
        .withColumn("ratio", ratio)
        .withColumn("row", key)
    )
    mixed = F.xxhash64("row", "source", F.lit(plan.seed))
    base = F.floor("ratio")
    units = joined.select(
        "row", "doc_id", "source", "size", "source_size", "target", base.alias("base"),
        (F.col("ratio") - base).alias("chance"),
        mixed.alias("bucket"),
    )
    units = staged(units, "units")
    open_ = (F.col("chance") > EPS) & (F.col("chance") < 1 - EPS)
    sample = balanced_sample(units.filter(open_).select("row", "source", "size", "chance", "bucket"))
    sample = staged(sample.filter("chance > 0.5").select("row", F.col("source").alias("_source")), "sample")
    extra = F.col("_picked").isNotNull().cast("long")
    picked = sample.select(F.col("row").alias("_picked"), "_source")
    return units.join(
        picked, (units["row"] == picked["_picked"]) & units["source"].eqNullSafe(picked["_source"]), "left"
    ).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("base") + F.when(open_, extra).otherwise(F.round("chance").cast("long"))).cast("int").alias("copies"),
        ((F.col("base") + F.when(open_, extra).otherwise(F.round("chance").cast("long"))) * F.col("size")).cast("long").alias("taken"),
    )
