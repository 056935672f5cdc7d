"""Registered queries by area."""

from __future__ import annotations

import importlib

AREAS = (
    "corpus", "retrieval", "audit", "provenance", "geo", "eventlog", "timeline", "sections", "incremental",
)


def load_all():
    """Import every area once and return the registry."""
    for area in AREAS:
        importlib.import_module(f"{__name__}.{area}")
    return importlib.import_module(f"{__name__}.registry")
