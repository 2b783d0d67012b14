"""Queries over the given tables, by name."""

from __future__ import annotations

import importlib

MODULES = ("document_features", "corpus", "modelling", "round_trips", "feature_profiles")


def load_all():
    """Import every query module and return the registered queries and SQL."""
    for module in MODULES:
        importlib.import_module(f"textgrade.plans.{module}")
    from textgrade.plans import registry

    return registry.QUERIES, registry.SQL
