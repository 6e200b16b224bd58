"""Queries and SQL of the training-data operators; the entry module adds them when this folder exists."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules with ``QUERIES`` (name -> callable) and, where SQL can state the result, ``SQL`` (name -> text).
MODULES = ("p1_scan_noise", "p2_split", "p3_pairs", "p4_names", "p5_language", "p6_truncation", "p7_encode", "p8_mix", "p9_quality")


def _modules():
    for name in MODULES:
        yield importlib.import_module(f"{__package__}.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for m in _modules() for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _modules() for k, q in getattr(m, "SQL", {}).items()}
