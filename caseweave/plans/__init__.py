"""Bindings of the operators to the driver's tables."""

from __future__ import annotations

import importlib

from caseweave.plans import registry

MODULES = ["relational", "summaries", "timelines", "strings", "networks", "models", "products", "streams"]


def _load() -> None:
    for name in MODULES:
        try:
            importlib.import_module(f"caseweave.plans.{name}")
        except ModuleNotFoundError as err:
            if err.name != f"caseweave.plans.{name}":
                raise


def queries() -> dict:
    _load()
    return dict(registry.QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return {name: registry.with_ctes(*parts) for name, parts in registry.ORACLES.items()}
