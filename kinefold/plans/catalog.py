"""All registered queries of the core."""

from __future__ import annotations

import importlib

from kinefold.plans.registry import Registry

MODULES = ("data_quality_queries", "recording_queries", "report_queries", "log_queries", "evaluation_queries", "relational_queries", "streaming_queries")


def all_queries() -> Registry:
    """A fresh registry with the queries of every core module."""
    whole = Registry()
    for name in MODULES:
        whole.update(importlib.import_module(f"kinefold.plans.{name}").REGISTRY)
    return whole
