"""Registered queries, one module per family; importing a module registers its queries."""

from __future__ import annotations

import importlib
import pkgutil

from quarrylog.registry import ORACLES, QUERIES, QueryFn


def load() -> tuple[dict[str, QueryFn], dict[str, str]]:
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
    return dict(QUERIES), dict(ORACLES)
