"""Named queries, one module per operator group."""

from __future__ import annotations

import importlib

GROUPS = [
    "sourcing",
    "cleaning",
    "profiling",
    "quality",
    "demand",
    "features",
    "classify",
    "forecast",
    "models",
    "context",
    "health",
    "recommend",
    "summary",
    "evaluate",
    "explain",
]

_members: dict[str, list[str]] = {}


def load_all():
    """All registered queries and their check SQL."""
    from pantrylens.plans import registry

    for group in GROUPS:
        if group in _members:
            continue
        before = set(registry.QUERIES)
        importlib.import_module(f"pantrylens.plans.{group}")
        _members[group] = [n for n in registry.QUERIES if n not in before]
    return registry.QUERIES, registry.ORACLES


def group_names(group: str) -> list[str]:
    load_all()
    return _members[group]
