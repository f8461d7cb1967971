"""Registered queries: each is a Spark callable next to the SQL that restates it."""

from __future__ import annotations

import importlib

MODULES = ("catalog", "splits", "ordinal", "metrics", "store", "attention", "crops", "history", "tiles", "streams", "training")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"bagspark.queries.{name}")
