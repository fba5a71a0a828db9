"""File-source Structured Streaming over event tables.

Selection, observables and features are stateless row transforms, so the batch functions
run unchanged on a stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jetloom.operators.selection import zip_jets
from jetloom.sources.readers import LAYOUTS

Transform = Callable[[DataFrame], DataFrame]


def stream_events(
    spark: SparkSession,
    path: str,
    layout: str = "nested",
    files_per_batch: int = 1,
    lineage: bool = False,
    skip_bad_files: bool = False,
) -> DataFrame:
    """A streaming scan that picks up ``files_per_batch`` files per micro-batch."""
    reader = spark.readStream.schema(LAYOUTS[layout]).option("maxFilesPerTrigger", files_per_batch)
    if skip_bad_files:
        reader = reader.option("ignoreCorruptFiles", True)
    table = reader.parquet(path)
    if lineage:
        table = table.select("*", F.col("_metadata.file_path").alias("file_path"))
    return zip_jets(table) if layout == "parallel" else table


def process_to_parquet(stream: DataFrame, transform: Transform, path: str, checkpoint: str) -> None:
    """Run all available files through ``transform`` into a Parquet sink, exactly once."""
    query = (
        transform(stream)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def process_batches(
    stream: DataFrame, transform: Transform, path: str, checkpoint: str
) -> None:
    """Run a user function per micro-batch and write each under its batch number.

    A batch replayed after a failure overwrites its own folder, so nothing is doubled.
    """

    def write(batch: DataFrame, number: int) -> None:
        target = f"{path}/batch_id={number}"
        transform(batch).write.mode("overwrite").option("compression", "snappy").parquet(target)

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
