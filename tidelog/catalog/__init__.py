"""Registered queries and their SQL, by name."""

from __future__ import annotations


def load() -> tuple[dict, dict]:
    from tidelog.catalog import assembly, features, logs, measures, registry, runs  # noqa: F401

    return registry.QUERIES, registry.ORACLE
