"""Exact distribution statistics without a global sort in one task.

Everything here rests on :func:`cumulate`: equal values are first collapsed to one row
with a weight (so a value held by a third of the table costs one row), distinct values
are dealt into value ranges of equal population, and running totals are taken inside
each range on top of the totals of the ranges below it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jetloom.functions.pvalues import correlation_pvalue, kolmogorov_pvalue
from jetloom.operators.order_statistics import BUCKETS, interpolated
from jetloom.session import stage

# A value held by at least 1/HOT_SHARE of the rows (or a quarter of a fair share of a
# partition, where that is less) is hot; there are at most as many as that share says.
HOT_SHARE = 1000


def _range_count(df: DataFrame) -> int:
    """As many value ranges as the session has shuffle partitions, at least two."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _range_edges(counts: DataFrame, ranges: int) -> dict[str, list[float]]:
    """Per series, the values that cut its distinct values into equal ranges.

    ``ranges`` numbers per series reach the driver; both factors are set by the session
    and the column list, not by the data.
    """
    cut_points = [i / ranges for i in range(1, ranges)]
    rows = counts.groupBy("series").agg(
        F.percentile_approx("x", cut_points, max(10_000, 20 * ranges)).alias("edges")
    ).collect()
    return {r["series"]: sorted({e for e in r["edges"] if math.isfinite(e)}) for r in rows}


def _tag_ranges(counts: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """``_range``: the value range of x in its series, by binary search over the edges."""
    tagged = counts
    chosen = F.lit(0.0)
    for i, (series, cuts) in enumerate(sorted(edges.items())):
        if not cuts:
            continue
        search = Bucketizer(
            splits=[-math.inf, *cuts, math.inf], inputCol="x", outputCol=f"_range_{i}", handleInvalid="keep"
        )
        tagged = search.transform(tagged)
        chosen = F.when(F.col("series") == series, F.col(f"_range_{i}")).otherwise(chosen)
    return tagged.select(*counts.columns, chosen.cast("int").alias("_range"))


def cumulate(counts: DataFrame, weights: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Running totals over ``counts(series, x, <weights>)``, unique on (series, x).

    Adds for each weight w ``before_w`` (sum over smaller x in the series) and
    ``total_w``, plus ``next_x``, the following distinct value (null at the end).
    """
    counts = stage(counts)
    tagged = _tag_ranges(counts, _range_edges(counts, ranges or _range_count(counts)))
    per_range = tagged.groupBy("series", "_range").agg(
        F.min("x").alias("_first"), *[F.sum(w).alias(f"_sum_{w}") for w in weights]
    )
    ordered = Window.partitionBy("series").orderBy("_range")
    below = ordered.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("series")
    offsets = per_range.select(
        "series",
        "_range",
        F.lead("_first").over(ordered).alias("_next_first"),
        *[F.coalesce(F.sum(f"_sum_{w}").over(below), F.lit(0)).alias(f"_below_{w}") for w in weights],
        *[F.sum(f"_sum_{w}").over(whole).alias(f"total_{w}") for w in weights],
    )
    inside = Window.partitionBy("series", "_range").orderBy("x")
    smaller = inside.rowsBetween(Window.unboundedPreceding, -1)
    # At most `ranges` rows per series.
    return tagged.join(F.broadcast(offsets), ["series", "_range"]).select(
        "series",
        "x",
        *weights,
        *[
            (F.coalesce(F.sum(w).over(smaller), F.lit(0)) + F.col(f"_below_{w}")).alias(f"before_{w}")
            for w in weights
        ],
        *[f"total_{w}" for w in weights],
        F.coalesce(F.lead("x").over(inside), F.col("_next_first")).alias("next_x"),
    )


# ---------------------------------------------------------------- two samples


def joint_table(df: DataFrame, a: str, b: str, ranges: int | None = None, times: str | None = None) -> DataFrame:
    """Cumulated counts of columns ``a`` and ``b`` on their common support.

    One such table answers KS, Wasserstein, quantiles and ranks of both columns.
    ``times`` names a multiplicity column of an already collapsed table.
    """
    weight = F.col(times) if times else F.lit(1).cast("bigint")
    zero = F.lit(0).cast("bigint")
    samples = F.array(
        F.struct(F.col(a).cast("double").alias("x"), weight.alias("n_a"), zero.alias("n_b")),
        F.struct(F.col(b).cast("double").alias("x"), zero.alias("n_a"), weight.alias("n_b")),
    )
    counts = (
        df.select(F.inline(samples))
        .where(F.col("x").isNotNull())
        .groupBy(F.lit("joint").alias("series"), "x")
        .agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    )
    return cumulate(counts, ["n_a", "n_b"], ranges)


def joint_cdf(df: DataFrame, a: str, b: str, ranges: int | None = None) -> DataFrame:
    """Both empirical CDFs on the common support."""
    return cdf_of(joint_table(df, a, b, ranges))


def cdf_of(table: DataFrame) -> DataFrame:
    """The two CDFs of a :func:`joint_table`."""
    return table.select(
        "x",
        "next_x",
        "total_n_a",
        "total_n_b",
        ((F.col("before_n_a") + F.col("n_a")) / F.col("total_n_a")).alias("cdf_a"),
        ((F.col("before_n_b") + F.col("n_b")) / F.col("total_n_b")).alias("cdf_b"),
    )


def two_sample_distances(cdf: DataFrame) -> DataFrame:
    """Kolmogorov-Smirnov statistic with p-value, and Wasserstein-1 distance (1 row)."""
    gap = F.abs(F.col("cdf_a") - F.col("cdf_b"))
    step = F.coalesce(F.col("next_x") - F.col("x"), F.lit(0.0))
    return cdf.agg(
        F.max(gap).alias("kolmogorov_smirnov_statistic"),
        F.sum(gap * step).alias("wasserstein_distance"),
        F.max("total_n_a").alias("_n_a"),
        F.max("total_n_b").alias("_n_b"),
    ).select(
        "kolmogorov_smirnov_statistic",
        kolmogorov_pvalue(
            F.col("kolmogorov_smirnov_statistic"), F.col("_n_a"), F.col("_n_b")
        ).alias("kolmogorov_smirnov_pvalue"),
        "wasserstein_distance",
    )


# ---------------------------------------------------------------- quantiles


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(series, x, n): distinct values of each column with their multiplicity."""
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = doubles.unpivot([], list(columns), "series", "x")
    return long.where(F.col("x").isNotNull()).groupBy("series", "x").agg(
        F.count(F.lit(1)).alias("n")
    )


def quantiles_of(table: DataFrame, probabilities: Sequence[float], weight: str = "n") -> DataFrame:
    """(series, q, value): linearly interpolated quantiles of a cumulated table.

    Each distinct value knows the sorted positions it covers, so the few rows next to a
    wanted position are found by a filter, without a join: a binary search over the
    probabilities first, the exact test on what is left.
    """
    last = F.col(f"total_{weight}") - 1
    start = F.col(f"before_{weight}")
    end = start + F.col(weight)
    wanted = F.array(*[F.lit(float(q)) for q in probabilities])

    def low(q: Column) -> Column:
        return F.floor(last * q)

    def covered(position: Column) -> Column:
        return (position >= start) & (position < end)

    def touches(q: Column) -> Column:
        return (low(q) < end) & (low(q) + 1 >= start)

    def both_ends(q: Column) -> Column:
        return F.struct(
            q.alias("q"),
            (last * q - low(q)).alias("part"),
            covered(low(q)).alias("low"),
            covered(low(q) + 1).alias("high"),
        )

    scale = F.greatest(last, F.lit(1).cast("bigint"))
    search = Bucketizer(
        splitsArray=[[-math.inf, *sorted({float(q) for q in probabilities}), math.inf]] * 2,
        inputCols=["_from", "_to"],
        outputCols=["_q_from", "_q_to"],
    )
    # One position of slack on either side absorbs rounding of the shares.
    shares = table.where(F.col(weight) > 0).withColumns(
        {"_from": (start - 2) / scale, "_to": (end + 1) / scale}
    )
    near = search.transform(shares).where(F.col("_q_to") > F.col("_q_from"))
    hits = F.transform(F.filter(wanted, touches), both_ends)
    ends = (
        near.select("series", "x", F.inline(hits))
        .groupBy("series", "q")
        .agg(
            F.max(F.when(F.col("low"), F.col("x"))).alias("a"),
            F.max(F.when(F.col("high"), F.col("x"))).alias("b"),
            F.max("part").alias("part"),
        )
    )
    a, part = F.col("a"), F.col("part")
    between = a + part * (F.coalesce(F.col("b"), a) - a)
    return ends.select("series", "q", F.when(part == 0, a).otherwise(between).alias("value"))


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], buckets: int | None = None
) -> DataFrame:
    """(series, q, value) for every column and probability, ``numpy.quantile`` rules.

    Found by refinement of bucket counts: no distinct value is shuffled on its own until few rows are left.
    """
    rows = interpolated(df, columns, probabilities, buckets or BUCKETS)
    return df.sparkSession.createDataFrame(rows, "series string, q double, value double")


# ---------------------------------------------------------------- ranks


def _attach_rank(
    df: DataFrame, table: DataFrame, column: str, weight: str, spread_by: Column, out: str
) -> DataFrame:
    """Look up the average rank of ``column`` without sending a hot value to one task.

    Heat is judged by the rows of ``df`` that would meet, not by their weights. Hot values
    (at most ``share`` of them, by counting) are answered from a broadcast table; their
    rows then travel through the shuffled lookup under many salts.
    """
    share = max(HOT_SHARE, 4 * _range_count(df))
    rows = df.count()
    held = F.col(weight)
    rank = F.col(f"before_{weight}") + (held + 1) / 2
    mine = table.where(held > 0)
    meeting = df.groupBy(F.col(column).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("_meeting"))
    crowded = meeting.where(F.col("_meeting") * share >= F.lit(rows)).select("x")
    hot = mine.join(F.broadcast(crowded), "x", "left_semi").select(F.col("x").alias("_x"), rank.alias("_hot"))
    # Ordinary values take a salt from themselves, on both sides; a constant salt would be
    # folded out of the join key. Rows already answered take a salt no lookup row has.
    salts = F.lit(_range_count(df)).cast("bigint")
    own_salt = F.pmod(F.xxhash64("_x"), salts)
    cold = mine.select(F.col("x").alias("_x"), rank.alias("_cold")).withColumn("_salt", own_salt)
    salt = F.when(F.col("_hot").isNull(), own_salt).otherwise(salts + F.pmod(F.xxhash64(spread_by), salts))
    looked_up = (
        df.withColumn("_x", F.col(column).cast("double"))
        .join(F.broadcast(hot), "_x", "left")
        .withColumn("_salt", salt)
        .join(cold, ["_x", "_salt"], "left")
    )
    return looked_up.withColumn(out, F.coalesce("_hot", "_cold")).drop("_x", "_salt", "_hot", "_cold")


def distinct_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Complete (a, b) pairs with their multiplicity ``times``; copies collapse map-side."""
    complete = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return complete.groupBy(F.col(a), F.col(b)).agg(F.count(F.lit(1)).alias("times"))


def spearman(df: DataFrame, a: str, b: str, ranges: int | None = None) -> DataFrame:
    """Spearman correlation (average ranks for ties) and its p-value, one row."""
    pairs = stage(distinct_pairs(df, a, b))
    return spearman_of(pairs, stage(joint_table(pairs, a, b, ranges, "times")), a, b)


def spearman_of(pairs: DataFrame, table: DataFrame, a: str, b: str) -> DataFrame:
    """:func:`spearman` from :func:`distinct_pairs` and their :func:`joint_table`."""
    both = _attach_rank(pairs, table, a, "n_a", F.col(b), "_rank_a")
    both = _attach_rank(both, table, b, "n_b", F.col(a), "_rank_b")
    return both.agg(
        _weighted_corr(F.col("_rank_a"), F.col("_rank_b"), F.col("times")).alias("spearman_correlation"),
        F.sum("times").alias("_n"),
    ).select(
        "spearman_correlation",
        correlation_pvalue(F.col("spearman_correlation"), F.col("_n")).alias("spearman_pvalue"),
    )


def _weighted_corr(a: Column, b: Column, w: Column) -> Column:
    """Pearson correlation of two rank columns with integer weights.

    Rank variance is about a third of the squared mean rank at any table length, so the
    difference of sums stays well conditioned.
    """
    n = F.sum(w)
    mean_a, mean_b = F.sum(w * a) / n, F.sum(w * b) / n
    cov = F.sum(w * a * b) / n - mean_a * mean_b
    var_a = F.sum(w * a * a) / n - mean_a * mean_a
    var_b = F.sum(w * b * b) / n - mean_b * mean_b
    return F.try_divide(cov, F.sqrt(var_a * var_b))
