"""Registered queries, each with the SQL it is checked against."""

from __future__ import annotations

import importlib

from pooltide.catalog.base import ORACLE, QUERIES, Query

_SECTIONS = ("legs", "features", "backtest", "reports", "dashboards", "play", "ingest")


def _load() -> None:
    for section in _SECTIONS:
        importlib.import_module(f"pooltide.catalog.{section}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
