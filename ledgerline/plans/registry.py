"""Query registry: every registered query is ``(spark, sf_dir) -> DataFrame``
and (when SQL can state it) has a DuckDB oracle over the same raw tables."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

_MODULES = (
    "ledgerline.plans.panel_queries",
    "ledgerline.plans.dashboard_queries",
    "ledgerline.plans.report_queries",
    "ledgerline.plans.peer_queries",
    "ledgerline.plans.profile_queries",
    "ledgerline.plans.prep_queries",
    "ledgerline.plans.timeseries_queries",
    "ledgerline.plans.ingest_queries",
    "ledgerline.plans.source_queries",
    "ledgerline.plans.forecast_queries",
    "ledgerline.plans.learner_queries",
    "ledgerline.plans.scoring_queries",
    "ledgerline.plans.access_queries",
    "ledgerline.plans.flagship",
)


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    for m in _MODULES:
        try:
            importlib.import_module(m)
        except ModuleNotFoundError as e:
            if e.name != m:
                raise


def queries() -> dict[str, QueryFn]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(ORACLES)
