"""The registered queries of the time-series operators, and their SQL."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from duosignal import catalog
from duosignal.catalog import registry

for _module in pkgutil.iter_modules(catalog.__path__):
    importlib.import_module(f"{catalog.__name__}.{_module.name}")


def queries() -> dict[str, Callable]:
    return registry.QUERIES


def oracle_sql() -> dict[str, str]:
    return registry.ORACLES
