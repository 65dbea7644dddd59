"""The registered queries, one module per area."""

from __future__ import annotations

import importlib
import pkgutil


def load_all():
    """Import every module of this package and return the filled registry."""
    for found in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{found}")
    return importlib.import_module(f"{__name__}.registry")
