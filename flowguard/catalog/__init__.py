"""Registered queries and their SQL counterparts."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowguard.catalog.registration import ORACLES, QUERIES

_MODULES = ("data", "prepare", "evaluate", "drift", "registry", "scoring", "models", "streams")


def load_all() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    for name in _MODULES:
        importlib.import_module(f"flowguard.catalog.{name}")
    return dict(QUERIES), dict(ORACLES)
