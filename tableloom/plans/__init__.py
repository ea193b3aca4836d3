"""Named queries over the local tables, each with its SQL check."""

from __future__ import annotations

import importlib

from tableloom.plans.registry import REGISTRY, Query

_MODULES = ["relational", "quality", "measured", "structures"]


def load() -> dict[str, Query]:
    """Every registered query by name."""
    for module in _MODULES:
        importlib.import_module(f"tableloom.plans.{module}")
    return dict(REGISTRY)
