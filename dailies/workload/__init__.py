"""Queries over the given tables."""

from __future__ import annotations

import importlib

MODULES = ("interval_queries", "text_queries", "layout_queries", "ledger_queries", "source_queries", "catalogue_queries", "resolve_queries", "upgrade_queries", "assembly_queries", "report_queries", "rule_queries")


def load_all():
    from dailies.workload.registry import ORACLES, QUERIES

    for name in MODULES:
        importlib.import_module(f"dailies.workload.{name}")
    return QUERIES, ORACLES
