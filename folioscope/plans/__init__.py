"""Registered queries and their SQL twins, grouped by subject."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    """Import every module of this package, which registers its queries."""
    for module in pkgutil.iter_modules(__path__):
        if module.name != "registry":
            importlib.import_module(f"{__name__}.{module.name}")
