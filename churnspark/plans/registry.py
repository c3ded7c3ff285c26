"""Registry of named queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from churnspark.sources.tables import Warehouse


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Warehouse], DataFrame]
    check: str | None
    covers: str


QUERIES: dict[str, Query] = {}


def query(covers: str, check: str | None = None, name: str | None = None):
    """Register a function Warehouse -> DataFrame under its own name."""

    def add(build):
        key = name or build.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = Query(key, build, check, covers)
        return build

    return add


#: Named building blocks of the check SQL: name -> (names it needs, body).
BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {}


def block(name: str, body: str, *needs: str) -> None:
    if name in BLOCKS:
        raise ValueError(f"block {name} defined twice")
    BLOCKS[name] = (needs, body)


def sql(body: str, *needs: str) -> str:
    """Check SQL: the blocks it needs, in dependency order, before the body."""
    ordered: list[str] = []

    def visit(name):
        if name not in ordered:
            for other in BLOCKS[name][0]:
                visit(other)
            ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return body
    parts = ",\n".join(f"{name} AS MATERIALIZED ({BLOCKS[name][1]})" for name in ordered)
    return f"WITH {parts}\n{body}"
