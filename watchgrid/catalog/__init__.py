"""Registered queries over the given tables, grouped by inventory section."""

from __future__ import annotations

import importlib

_MODULES = ("validation", "cameras", "frames", "boxes", "water", "evaluation", "scalars", "streams")


def load_catalog():
    """Import every query module once and return the registry they fill."""
    registry = importlib.import_module("watchgrid.catalog.registry")
    for name in _MODULES:
        importlib.import_module(f"watchgrid.catalog.{name}")
    return registry
