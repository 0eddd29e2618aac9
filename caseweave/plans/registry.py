"""Named queries over the driver's tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, tuple[tuple[str, ...], str, str]] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body)


def with_ctes(names: tuple[str, ...], select: str, recursive: str = "") -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for need in CTES[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    # a recursive query reads its inputs once per step, so they are computed up front
    keep = "MATERIALIZED " if recursive else ""
    parts = [f"{name} AS {keep}({CTES[name][1].strip()})" for name in order]
    if recursive:
        parts.append(recursive.strip())
    if not parts:
        return select.strip()
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + select.strip()


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = (), recursive: str = ""):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise KeyError(name)
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = (uses, sql, recursive)
        return fn

    return register
