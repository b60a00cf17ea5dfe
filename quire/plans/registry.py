"""Registry of named queries and the SQL each one is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans.views import DUCK_VIEWS, Views

_QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(views) -> DataFrame`` under ``name`` with its reference SQL."""

    def wrap(fn: Callable[[Views], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = with_views(oracle)
        return fn

    return wrap


def with_views(body: str) -> str:
    """Put the input views that ``body`` names in front of it as CTEs, dependencies first."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, sql in DUCK_VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(sql)
                if name not in needed:
                    needed.append(name)

    visit(body)
    body = body.strip()
    if not needed:
        return body
    ctes = ",\n".join(f"{n} as ({DUCK_VIEWS[n].strip()})" for n in needed)
    recursive = re.match(r"with\s+recursive\b", body, re.IGNORECASE)
    tail = re.match(r"with\s+(?:recursive\s+)?", body, re.IGNORECASE)
    head = "with recursive " if recursive else "with "
    if tail:
        return f"{head}{ctes},\n{body[tail.end():]}"
    return f"{head}{ctes}\n{body}"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: fn(Views(spark, sf_dir))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def oracles() -> dict[str, str]:
    return dict(_ORACLES)
