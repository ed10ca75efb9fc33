"""Key -> query and key -> oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Register a query, with the oracle SQL over the named fixture views where there is one."""

    def register(fn: Query) -> Query:
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = oracle(sql, views.split())
        return fn

    return register


def r(c: str | Column, digits: int = 6) -> Column:
    """Round for comparison with the oracle."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def q(expr: str, digits: int = 6) -> str:
    """The oracle's spelling of ``r``; adding zero removes a negative zero."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"


_DEPENDS: dict[str, tuple[str, ...]] = {}
_VIEWS: dict[str, str] = {}


def view(name: str, sql: str, needs: str = "") -> None:
    _VIEWS[name] = sql
    _DEPENDS[name] = tuple(needs.split())


def oracle(sql: str, views: list[str]) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for d in _DEPENDS[name]:
            visit(d)
        if name not in ordered:
            ordered.append(name)

    for v in views:
        visit(v)
    if not ordered:
        return sql
    body = ",\n".join(f"{n} AS ({_VIEWS[n]})" for n in ordered)
    more = sql.lstrip().startswith(",")  # further steps, perhaps recursive ones, follow the views
    return f"WITH {'RECURSIVE ' if more else ''}{body}\n{sql}"
