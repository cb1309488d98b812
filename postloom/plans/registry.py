"""All core queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ["nested_labels", "instants", "posts", "topics", "scores", "events", "flows", "pages", "walls", "cleaning", "quality", "tools"]


def _collect(kind: str) -> dict:
    out: dict = {}
    for m in MODULES:
        for name, value in getattr(import_module(f"postloom.plans.{m}"), kind).items():
            if name in out:
                raise ValueError(f"two queries are named {name}")
            out[name] = value
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("SQL")
