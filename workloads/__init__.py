"""Registered queries over the driver's tables, each next to its SQL oracle."""

from __future__ import annotations


def registry():
    """All workloads by name."""
    from workloads import base, known_labels, learning, physics, scans, statistics  # noqa: F401

    return base.REGISTRY
