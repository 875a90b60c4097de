"""Registered queries: each runs an operator over the shared tables and, where SQL can say it, carries the SQL."""

from __future__ import annotations

from retrievo.plans import registry


def load() -> None:
    """Import every module that registers queries."""
    from retrievo.plans import (  # noqa: F401
        adaptive, evaluation, files, guarded, ingestion, memory, retrieval, sources, streams, telemetry, text, traces,
    )


def queries():
    load()
    return dict(registry.QUERIES)


def oracle_sql():
    load()
    return dict(registry.SQL)
