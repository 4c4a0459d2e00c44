"""Registers queries, each with the SQL that checks it."""
from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, sql: str, uses: Iterable[str] = ()) -> None:
    VIEWS[name] = (tuple(uses), sql.strip())


def _ordered(names: Iterable[str], seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            _ordered(VIEWS[name][0], seen)
            seen.append(name)
    return seen


def with_views(sql: str, uses: Iterable[str]) -> str:
    names = _ordered(uses, [])
    if not names:
        return sql.strip()
    body = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in names)
    text = sql.strip()
    if text[:5].upper() == "WITH ":
        return f"WITH {body},\n{text[5:]}"
    return f"WITH {body}\n{text}"


def query(name: str, sql: str | None = None, uses: Iterable[str] = ()):
    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, uses)
        return fn
    return register
