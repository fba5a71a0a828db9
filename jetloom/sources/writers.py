"""Sinks; every task writes its own part, nothing passes through the driver."""

from __future__ import annotations

import os.path
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jetloom.session import stage_path


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Snappy Parquet."""
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header line per part file."""
    df.write.mode(mode).option("header", True).csv(path)


def write_json_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON record per line."""
    df.write.mode(mode).json(path)


def read_json_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read :func:`write_json_records` output under its schema."""
    return spark.read.schema(schema).json(path)


def write_stage(df: DataFrame, label: str = "stage") -> str:
    """Materialise a processed table in the shared folder; returns its path."""
    path = stage_path(df.sparkSession, label)
    write_parquet(df, path)
    return path


def reload_stage(spark: SparkSession, path: str) -> DataFrame:
    """Read a table back from :func:`write_stage`."""
    return spark.read.parquet(path)


def per_source_output(df: DataFrame, path: str, file_path: str = "file_path", root: str | None = None) -> None:
    """One output folder per input file, named by the file's path below ``root`` without its suffix.

    ``root`` is by default the folder that all input files share, so files of one name in two folders stay apart. It
    follows from the first and the last path in order. Rows are written by the tasks that hold them: a file contributing
    much of the table yields several part files instead of one long task.
    """
    if root is None:
        ends = df.agg(F.min(file_path), F.max(file_path)).first()
        shared = os.path.commonprefix([p or "" for p in ends])
        root = shared[: shared.rfind("/") + 1]
    elif not root.endswith("/"):
        root += "/"
    # Paths of a scan carry a scheme, a given root may not.
    below = F.regexp_replace(F.col(file_path), "^([a-z0-9]+:(//)?)?" + re.escape(re.sub("^[a-z0-9]+:(//)?", "", root)), "")
    stem = F.regexp_replace(below, r"\.[^./]*$", "")
    out = df.withColumn("source_file", stem).drop(file_path)
    out.write.mode("overwrite").option("compression", "snappy").partitionBy("source_file").parquet(path)
