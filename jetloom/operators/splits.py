"""Deterministic splits that depend on the event id alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the id hash (two rounds modulo the Mersenne prime 2^31 - 1).
PRIME = 2_147_483_647
MULTIPLIER = 742_938_285
FOLD = 1_000_003

SEED = 42


def split_hash(event_id: Column | str, seed: int = SEED) -> Column:
    """Integer in [0, PRIME) from the id and the seed; plain 64-bit arithmetic."""
    key = F.col(event_id) if isinstance(event_id, str) else event_id
    prime = F.lit(PRIME).cast("bigint")
    a = F.pmod(key.cast("bigint"), prime)
    b = F.pmod(a * F.lit(MULTIPLIER).cast("bigint") + F.lit(seed).cast("bigint"), prime)
    return F.pmod(b * F.pmod(b, F.lit(FOLD).cast("bigint")) + a, prime)


def below(event_id: Column | str, share: float, seed: int) -> Column:
    """True for about ``share`` of the ids."""
    return split_hash(event_id, seed) < F.lit(int(share * PRIME)).cast("bigint")


def add_split(
    df: DataFrame,
    test_size: float = 0.2,
    validation_size: float = 0.2,
    seed: int = SEED,
    key: str = "event_id",
) -> DataFrame:
    """``split`` column: test, then validation out of the rest, then train.

    No shuffle, and the same under any partitioning or retry.
    """
    split = (
        F.when(below(key, test_size, seed), "test")
        .when(below(key, validation_size, seed + 1), "validation")
        .otherwise("train")
    )
    return df.withColumn("split", split)


def training_share(df: DataFrame, share: float = 0.5, seed: int = SEED, key: str = "event_id") -> DataFrame:
    """Detector training set: the given share of all events, chosen by hash of the id.

    No shuffle and no number of rows: it behaves alike at every table length. Rows without
    an id are not trained on.
    """
    return df.where(below(key, share, seed + 2))
