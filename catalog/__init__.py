"""Registered queries: each pairs a Spark callable with the SQL it must agree with."""

import importlib
import pkgutil


def load_all():
    """Import every catalog module and return ``(queries, oracles)``."""
    from catalog import base

    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"catalog.{module}")
    return base.QUERIES, base.ORACLES
