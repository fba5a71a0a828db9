"""Sources, sinks, unions, streaming and user functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from jetloom import sources as IO
from jetloom.cuts import LOOSE_CUTS
from jetloom.operators.selection import pick_pairs
from jetloom.plans import flows
from jetloom.schema import JET_FIELDS
from jetloom.session import stage_path
from jetloom.streaming import ingest
from workloads.base import (
    SQL_JETS,
    SQL_NESTED,
    jets,
    nested_events,
    query,
    rounded,
    sql_observed,
    sql_round,
    table,
)


def _written_events(spark, sf_dir, files: int = 3) -> str:
    """The array-layout events as a folder of Parquet files."""
    path = stage_path(spark, "events")
    nested_events(spark, sf_dir).repartition(files, "event_id").write.parquet(path)
    return path


def _written_jets(spark, sf_dir) -> str:
    path = stage_path(spark, "jets")
    jets(spark, sf_dir).write.parquet(path)
    return path


def _jet_rows(events, *extra):
    return events.select("event_id", *extra, F.inline("jets")).select("event_id", *extra, *JET_FIELDS)


NESTED_ROWS = (
    f"WITH {SQL_NESTED} SELECT event_id, {sql_round(['pt', 'eta', 'phi', 'm', 'jvt'])} FROM jets"
)
FLAT_ROWS = f"WITH {SQL_JETS} SELECT event_id, {sql_round(['pt', 'eta', 'phi', 'm', 'jvt'])} FROM jets"
PAIR_COLUMNS = [f"{s}_jet_{f}" for s in ("leading", "subleading") for f in ("pt", "eta", "phi", "m")]
LOOSE_PAIRS = (
    sql_observed(quality="pt > 50", balance=None, mass=None, source=SQL_NESTED)
    + f" SELECT event_id, n_jets, {sql_round(PAIR_COLUMNS)} FROM obs"
)


def _loose_pairs(events, keep=()):
    return pick_pairs(events, LOOSE_CUTS, keep=keep)


@query("s1_scan_nested_events", NESTED_ROWS)
def s1(spark, sf_dir):
    return rounded(_jet_rows(IO.read_events(spark, _written_events(spark, sf_dir))))


@query(
    "s3_dataset_info",
    "SELECT CAST(1 AS BIGINT) AS n_files, count(*) AS total_events, CAST(count(*) AS DOUBLE) AS avg_events_per_file"
    " FROM lineitem",
)
def s3(spark, sf_dir):
    # The size column depends on the files, not on the rows; it is checked in the tests.
    return IO.dataset_info(spark, f"{sf_dir}/lineitem.parquet").drop("total_size_gb")


@query(
    "s5_read_requested_columns",
    f"WITH {SQL_JETS} SELECT event_id, {sql_round(['pt', 'm'])} FROM jets",
)
def s5(spark, sf_dir):
    return rounded(IO.read_jets(spark, _written_jets(spark, sf_dir), columns=["pt", "m"]))


@query(
    "s6_scan_with_lineage",
    f"WITH {SQL_NESTED} SELECT event_id, count(*) AS n_jets, true AS has_file FROM jets GROUP BY event_id",
)
def s6(spark, sf_dir):
    events = IO.read_events(spark, _written_events(spark, sf_dir), lineage=True)
    return events.select(
        "event_id",
        F.size("jets").cast("bigint").alias("n_jets"),
        F.col("file_path").endswith(".parquet").alias("has_file"),
    )


@query(
    "s7_cap_events",
    f"WITH {SQL_NESTED}, capped AS (SELECT DISTINCT event_id FROM jets ORDER BY event_id LIMIT 100)"
    " SELECT event_id, count(*) AS n_jets FROM jets WHERE event_id IN (SELECT event_id FROM capped) GROUP BY event_id",
)
def s7(spark, sf_dir):
    capped = IO.cap_events(nested_events(spark, sf_dir), 100)
    return capped.select("event_id", F.size("jets").cast("bigint").alias("n_jets"))


def _with_junk(spark, sf_dir) -> list[str]:
    """Event files and a text file that claims nothing."""
    path = _written_events(spark, sf_dir)
    junk = stage_path(spark, "junk")
    table(spark, sf_dir, "region").select(F.col("r_name").alias("value")).coalesce(1).write.text(junk)
    files = spark.read.format("binaryFile").load(junk).select("path").where(F.col("path").endswith(".txt"))
    broken = [r["path"] for r in files.collect()]
    return [path, *broken]


@query("s8_skip_unreadable_files", NESTED_ROWS)
def s8(spark, sf_dir):
    return rounded(_jet_rows(IO.read_events(spark, _with_junk(spark, sf_dir), skip_bad_files=True)))


@query(
    "s8_scan_ledger",
    "SELECT 'read' AS status, CAST(3 AS BIGINT) AS files, count(*) AS events FROM embeddings"
    " UNION ALL SELECT 'empty or unreadable', 1, 0",
)
def s8_ledger(spark, sf_dir):
    ledger = stage_path(spark, "ledger")
    IO.read_events(spark, _with_junk(spark, sf_dir), skip_bad_files=True, ledger=ledger)
    return spark.read.parquet(ledger).groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.sum("events").alias("events"))


@query("s9_load_file_or_directory", FLAT_ROWS)
def s9(spark, sf_dir):
    return rounded(IO.read_table(spark, _written_jets(spark, sf_dir)))


def _processed(spark, sf_dir):
    return _loose_pairs(nested_events(spark, sf_dir))


@query("s11_materialise_processed", LOOSE_PAIRS)
def s11(spark, sf_dir):
    path = IO.write_stage(_processed(spark, sf_dir))
    return rounded(spark.read.parquet(path))


@query("s12_reload_processed", LOOSE_PAIRS)
def s12(spark, sf_dir):
    return rounded(IO.reload_stage(spark, IO.write_stage(_processed(spark, sf_dir))))


@query("s13_parquet_sink", LOOSE_PAIRS)
def s13(spark, sf_dir):
    path = stage_path(spark, "parquet")
    IO.write_parquet(_processed(spark, sf_dir), path)
    return rounded(spark.read.parquet(path))


@query("s14_csv_sink", LOOSE_PAIRS)
def s14(spark, sf_dir):
    path = stage_path(spark, "csv")
    processed = _processed(spark, sf_dir)
    IO.write_csv(processed, path)
    return rounded(spark.read.schema(processed.schema).option("header", True).csv(path))


@query("s15_json_records", LOOSE_PAIRS)
def s15(spark, sf_dir):
    path = stage_path(spark, "json")
    processed = _processed(spark, sf_dir)
    IO.write_json_records(processed, path)
    return rounded(IO.read_json_records(spark, path, processed.schema))


@query("s16_one_output_per_input_file", LOOSE_PAIRS)
def s16(spark, sf_dir):
    events = IO.read_events(spark, _written_events(spark, sf_dir), lineage=True)
    path = stage_path(spark, "per-source")
    IO.per_source_output(_loose_pairs(events, keep=("file_path",)), path)
    return rounded(spark.read.parquet(path).drop("source_file"))


@query("s16_equal_names_stay_apart", "SELECT vec_id AS event_id, vec_id % 2 AS half FROM embeddings")
def s16_equal_names(spark, sf_dir):
    # A task gives its files in both folders one name.
    halves = stage_path(spark, "halves")
    nested_events(spark, sf_dir).withColumn("half", F.col("event_id") % 2).write.partitionBy("half").parquet(halves)
    events = IO.read_events(spark, [f"{halves}/half={k}" for k in (0, 1)], lineage=True)
    path = stage_path(spark, "per-source")
    IO.per_source_output(events.select("event_id", "file_path"), path)
    half = F.regexp_extract("source_file", "^half=([01])/", 1).cast("bigint")
    return spark.read.parquet(path).select("event_id", half.alias("half"))


@query("s17_batched_scoring_from_list", LOOSE_PAIRS)
def s17(spark, sf_dir):
    folder = _written_events(spark, sf_dir, files=12)
    listing = spark.read.format("binaryFile").load(folder).select("path")
    file_list = stage_path(spark, "list")
    listing.orderBy("path").coalesce(1).withColumnRenamed("path", "value").write.text(file_list)
    output = stage_path(spark, "batches")
    flows.batch_inference(spark, file_list, output, lambda e: _loose_pairs(e, keep=("batch",)))
    return rounded(spark.read.parquet(output).drop("batch"))


# ---------------------------------------------------------------- union


@query(
    "u1_concatenate_tables",
    f"WITH {SQL_JETS}, both_tables AS (SELECT event_id, pt, jvt FROM jets UNION ALL "
    "SELECT event_id, pt, CAST(NULL AS DOUBLE) FROM jets) "
    "SELECT event_id, count(*) AS n_rows, count(jvt) AS n_jvt, round(sum(pt), 2) AS sum_pt "
    "FROM both_tables GROUP BY event_id",
)
def u1(spark, sf_dir):
    full = jets(spark, sf_dir)
    both = IO.union_tables([full.select("event_id", "pt", "jvt"), full.select("event_id", "pt")])
    return rounded(
        both.groupBy("event_id").agg(
            F.count(F.lit(1)).alias("n_rows"), F.count("jvt").alias("n_jvt"), F.sum("pt").alias("sum_pt")
        ),
        2,
    )


# ---------------------------------------------------------------- streaming


@query("t1_incremental_files", LOOSE_PAIRS)
def t1(spark, sf_dir):
    stream = ingest.stream_events(spark, _written_events(spark, sf_dir))
    path = stage_path(spark, "stream-out")
    ingest.process_to_parquet(stream, _loose_pairs, path, stage_path(spark, "stream-progress"))
    return rounded(spark.read.parquet(path))


@query("t2_per_batch_function", LOOSE_PAIRS)
def t2(spark, sf_dir):
    stream = ingest.stream_events(spark, _written_events(spark, sf_dir), files_per_batch=2)
    path = stage_path(spark, "batches-out")
    ingest.process_batches(stream, _loose_pairs, path, stage_path(spark, "batches-progress"))
    return rounded(spark.read.parquet(path).drop("batch_id"))


# ---------------------------------------------------------------- user functions


@query(
    "v1_user_function_over_chunks",
    f"WITH {SQL_JETS} SELECT event_id, round(pt / 1000.0, 6) AS pt_gev, eta > 0 AS forward FROM jets",
)
def v1(spark, sf_dir):
    def to_gev(chunk: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            {"event_id": chunk["event_id"], "pt_gev": chunk["pt"] / 1000.0, "forward": chunk["eta"] > 0}
        )

    source = flows.apply_column_function(jets(spark, sf_dir), lambda df: df.select("event_id", "pt", "eta"))
    schema = "event_id bigint, pt_gev double, forward boolean"
    return rounded(flows.apply_pandas_function(source, to_gev, schema))


@query("v2_user_functions_over_files", LOOSE_PAIRS)
def v2(spark, sf_dir):
    return rounded(flows.process_files(spark, _written_events(spark, sf_dir), [_loose_pairs]))
