"""Queries: operators bound to tables, each with the SQL that checks it."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    """Import every plan module so that its queries are registered."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_plans"):
            importlib.import_module(f"{__name__}.{module.name}")
