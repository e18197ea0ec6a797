"""Importing this module registers every query."""

import importlib
import pkgutil

from cardweir import plans

for module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
    if module.endswith("_queries"):
        importlib.import_module(f"{plans.__name__}.{module}")
