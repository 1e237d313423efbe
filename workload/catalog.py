"""All registered queries."""

from __future__ import annotations

import importlib

from workload import registry

MODULES = ("filters", "joins", "aggregates", "windows", "scalars", "records", "vectors", "tables_out", "streams")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"workload.{name}")


def all_queries():
    load()
    return dict(registry.QUERIES)


def all_oracles():
    load()
    return dict(registry.ORACLES)
