"""Import every query module so that the registry is full."""

import importlib
import pkgutil

from sensorframe.catalog.registry import ORACLE_SQL, QUERIES

for _module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
    importlib.import_module(f"{__name__}.{_module}")

__all__ = ["ORACLE_SQL", "QUERIES"]
