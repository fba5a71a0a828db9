"""Readers and writers for event tables."""

from jetloom.sources.readers import (
    cap_events,
    dataset_info,
    read_events,
    read_jets,
    read_table,
    scan_ledger,
    union_tables,
)
from jetloom.sources.writers import (
    per_source_output,
    read_json_records,
    reload_stage,
    write_csv,
    write_json_records,
    write_parquet,
    write_stage,
)

__all__ = [
    "cap_events",
    "dataset_info",
    "per_source_output",
    "read_events",
    "read_jets",
    "read_json_records",
    "read_table",
    "reload_stage",
    "scan_ledger",
    "union_tables",
    "write_csv",
    "write_json_records",
    "write_parquet",
    "write_stage",
]
