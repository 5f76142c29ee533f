"""Queries over the tables of a folder, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with equivalent SQL where there is any."""

    def register(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            ORACLES[key] = sql
        return fn

    return register


def load_all() -> None:
    from graphlode.plans import events, gates, graph, history, legacy, links, planning, relational, retrieval, review, scoring  # noqa: F401
