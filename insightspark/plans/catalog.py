"""All registered queries."""

from __future__ import annotations

import importlib

from insightspark.plans.registry import ORACLES, QUERIES

FAMILIES = [
    "sources", "relational", "windows", "profiling", "quality", "paradox", "verification",
    "scoring", "textlogs", "experiments", "timeseries", "customers", "cohorts", "product",
    "rootcause", "alerts", "streams",
]


def _load():
    for family in FAMILIES:
        importlib.import_module(f"insightspark.plans.{family}")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(ORACLES)
