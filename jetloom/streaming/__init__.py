"""Incremental processing of arriving event files."""
