"""Queries and the SQL that states the same, registered side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .testbed import SQL, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def q(name: str, sql: str | None = None, views: str = ""):
    """views: names of testbed tables that `sql` reads; each is put before it with what it needs."""

    def add(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(views) + sql
        return f

    return add


def with_views(views: str) -> str:
    wanted: list[str] = []

    def need(v: str) -> None:
        for other in SQL[v][0].split():
            need(other)
        if v not in wanted:
            wanted.append(v)

    for v in views.split():
        need(v)
    return "WITH RECURSIVE " + ", ".join(f"{v} AS ({SQL[v][1]})" for v in wanted) + " " if wanted else ""
