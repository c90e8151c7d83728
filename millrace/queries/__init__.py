"""Registered queries, one module per section of the operator inventory."""

import importlib

from millrace.queries.registry import ORACLES, QUERIES

_MODULES = ["sources", "columns", "catalogue", "relations", "quality", "profiles", "reports", "changes"]

for _name in _MODULES:
    importlib.import_module(f"millrace.queries.{_name}")

__all__ = ["ORACLES", "QUERIES"]
