"""Queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

import importlib
import pkgutil

import cargolume.llm.queries as _queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in sorted(m.name for m in pkgutil.iter_modules(_queries.__path__)):
    _loaded = importlib.import_module(f"{_queries.__name__}.{_module}")
    QUERIES |= _loaded.QUERIES
    ORACLES |= getattr(_loaded, "ORACLES", {})
