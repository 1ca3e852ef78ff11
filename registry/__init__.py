"""Registered queries: each one over the whole given tables, with its SQL twin."""

from __future__ import annotations

from importlib import import_module

MODULES = ("sources", "filters", "joins", "tfidf", "surprisal", "splits", "fits", "decisions", "metrics", "reports", "streams", "answers")


def _load() -> None:
    for name in MODULES:
        import_module(f"registry.{name}")


def all_queries() -> dict:
    from registry.base import QUERIES

    _load()
    return dict(QUERIES)


def all_oracle_sql() -> dict:
    from registry.base import ORACLE

    _load()
    return dict(ORACLE)
