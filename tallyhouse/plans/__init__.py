"""Named queries. ``load_queries`` imports every module that registers some."""

from __future__ import annotations

import importlib

MODULES = (
    "retail", "procedures", "governed", "texts", "vector_jobs", "template_jobs", "activity_jobs",
    "evaluation_jobs",
)


def load_queries():
    """All registered queries by name."""
    for module in MODULES:
        importlib.import_module(f"tallyhouse.plans.{module}")
    from tallyhouse.plans.registry import QUERIES

    return QUERIES
