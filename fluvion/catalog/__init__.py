"""Registered queries: each pairs a Spark job with the SQL that must give the same rows."""

from __future__ import annotations

import importlib

from fluvion.catalog.registry import ORACLES, QUERIES

SECTIONS = (
    "expressions",
    "joins",
    "aggregates",
    "series",
    "ordering",
    "scalars",
    "grids",
    "writes",
    "scans",
    "surfaces",
    "replay",
    "extensions",
    "streams",
)


def load() -> None:
    for section in SECTIONS:
        importlib.import_module(f"fluvion.catalog.{section}")


__all__ = ["ORACLES", "QUERIES", "load"]
