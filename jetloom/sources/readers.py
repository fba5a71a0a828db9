"""Scans of event tables stored as Parquet."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jetloom.operators.selection import zip_jets
from jetloom.operators.topk import first_by_key
from jetloom.schema import EVENT, FLAT_JET, PARALLEL_EVENT

LAYOUTS = {"nested": EVENT, "parallel": PARALLEL_EVENT, "flat": FLAT_JET}


def _reader(spark: SparkSession, schema: T.StructType, skip_bad_files: bool):
    reader = spark.read.schema(schema)
    if skip_bad_files:
        reader = reader.option("ignoreCorruptFiles", True)
    return reader


def read_events(
    spark: SparkSession,
    paths: str | Sequence[str],
    layout: str = "nested",
    columns: Sequence[str] | None = None,
    lineage: bool = False,
    skip_bad_files: bool = False,
    ledger: str | None = None,
) -> DataFrame:
    """Scan an event table with a pinned schema.

    ``parallel`` tables come back in the nested form. ``columns`` limits the properties
    read from a parallel or flat table (the scan then touches only those), ``lineage``
    adds the file each event came from, ``skip_bad_files`` leaves out unreadable files,
    and ``ledger`` names a folder that the :func:`scan_ledger` of the paths is written to.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {sorted(LAYOUTS)}, not {layout!r}")
    paths = [paths] if isinstance(paths, str) else list(paths)
    if ledger is not None:
        scan_ledger(spark, paths, layout).write.mode("overwrite").parquet(ledger)
    table = _reader(spark, LAYOUTS[layout], skip_bad_files).parquet(*paths)
    extra = [F.col("_metadata.file_path").alias("file_path")] if lineage else []
    if columns is not None:
        return table.select("event_id", *columns, *extra)
    table = table.select(*table.columns, *extra)
    return zip_jets(table) if layout == "parallel" else table


def scan_ledger(spark: SparkSession, paths: str | Sequence[str], layout: str = "nested") -> DataFrame:
    """What a scan with ``skip_bad_files`` makes of every listed file: (file_path, length, events, checksum, status).

    The listing left-joined with what the scan reads by file, all columns included, so a file that ends in the middle
    shows the events before its fault. ``status`` is read, or empty or unreadable; ``checksum`` is the XOR of all
    rows' hashes and tells two versions of a file apart.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    listed = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("file_path"), "length")
    found = _reader(spark, LAYOUTS[layout], True).parquet(*paths)
    counts = found.groupBy(F.col("_metadata.file_path").alias("file_path")).agg(
        F.count(F.lit(1)).alias("events"), F.bit_xor(F.xxhash64(*found.columns)).alias("checksum")
    )
    return listed.join(counts, "file_path", "left").select(
        "file_path",
        "length",
        F.coalesce("events", F.lit(0)).alias("events"),
        "checksum",
        F.when(F.col("events") > 0, "read").otherwise("empty or unreadable").alias("status"),
    )


def read_jets(spark: SparkSession, paths: str | Sequence[str], **options) -> DataFrame:
    """Scan a jet-per-row table."""
    return read_events(spark, paths, layout="flat", **options)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or directory; an empty directory is an error."""
    return spark.read.parquet(path)


def cap_events(events: DataFrame, max_events: int | None, key: str = "event_id") -> DataFrame:
    """At most ``max_events`` events, the first by id so that the cap is repeatable."""
    return events if max_events is None else first_by_key(events, key, max_events)


def dataset_info(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Files, size, exact event count and events per file, one row; empty files count too."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    # The listing alone: no file is opened for its path and length.
    files = spark.read.format("binaryFile").load(paths).select("path", "length")
    listed = files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("_bytes"))
    counted = spark.read.parquet(*paths).agg(F.count(F.lit(1)).alias("total_events"))
    # One row beside one row.
    return listed.join(counted, F.lit(True)).select(
        "n_files",
        (F.col("_bytes") / F.lit(1024.0**3)).alias("total_size_gb"),
        "total_events",
        F.try_divide(F.col("total_events").cast("double"), F.col("n_files")).alias("avg_events_per_file"),
    )


def union_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name; columns missing somewhere are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
