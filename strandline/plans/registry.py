"""Every core query and its SQL twin, gathered from the plan modules."""

from __future__ import annotations

import importlib

MODULES = ("catalog", "scalars", "changes", "archive", "more", "whole", "site", "layers", "published")


def _gather(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"strandline.plans.{name}"), attribute)
    return found


#: Queries on fixed rows or on a part of a table, each with a twin over the whole table: held against their SQL by tests, not registered.
UNREGISTERED = (
    "f05_theme_roots f08_css_urls f14_change_rows f15_revision_rows f16_file_links f30_sniff f36_journal g01_references f45_snapshots_above u09_import_meta s04_point_lookups"
).split()


def queries() -> dict:
    return {k: v for k, v in _gather("QUERIES").items() if k not in UNREGISTERED}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in _gather("ORACLE").items() if k not in UNREGISTERED}


def unregistered() -> dict[str, tuple]:
    """name -> (query, SQL)."""
    found, sql = _gather("QUERIES"), _gather("ORACLE")
    return {k: (found[k], sql[k]) for k in UNREGISTERED}
