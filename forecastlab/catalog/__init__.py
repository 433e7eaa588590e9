"""Checked queries over the given tables."""

from __future__ import annotations

import importlib

GROUPS = ("scans", "rows", "joins", "aggregates", "windows", "reshapes", "features", "models", "boosted", "scores")


def load():
    """The registry with every group of queries imported."""
    for group in GROUPS:
        importlib.import_module(f"forecastlab.catalog.{group}")
    return importlib.import_module("forecastlab.catalog.registry")
