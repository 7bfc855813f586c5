"""All registered queries."""

import importlib
import pkgutil

import forelake.plans
from forelake.plans.registry import QUERIES, SQL

for _module in pkgutil.iter_modules(forelake.plans.__path__):
    if _module.name.endswith("_queries"):
        importlib.import_module(f"forelake.plans.{_module.name}")

__all__ = ["QUERIES", "SQL"]
