"""All registered queries. Importing this module fills the registry."""
from __future__ import annotations

import importlib

from ..sources.fixtures import duckdb_with
from .registry import ORACLE, QUERIES

MODULES = ["q_scores", "q_anomalies", "q_trends", "q_search", "q_sizes", "q_ingest", "q_labels", "q_alerts", "q_maintained", "q_sources"]


def _load():
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")


_load()


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: duckdb_with(v) for k, v in ORACLE.items()}
