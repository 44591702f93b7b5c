"""Imports every query module so that its queries are registered."""

from __future__ import annotations

import importlib
import pkgutil

from pagewright import plans
from pagewright.plans import registry

_SKIP = {"catalog", "registry", "inputs"}


def _load() -> None:
    for module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
        if module not in _SKIP:
            importlib.import_module(f"{plans.__name__}.{module}")


def queries() -> dict[str, registry.Runner]:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)


def coverage() -> dict[str, list[str]]:
    """Inventory number -> names of the queries that run it."""
    _load()
    out: dict[str, list[str]] = {}
    for name, numbers in registry.COVERS.items():
        for number in numbers:
            out.setdefault(number, []).append(name)
    return out
