"""Named queries over the driver tables, each with an optional DuckDB oracle.

``query(name, sql)`` registers a callable ``(spark, sf_dir) -> DataFrame``;
the SQL (when given) is the same computation written for DuckDB over the
pre-registered table views. Numeric outputs are rounded identically on both
sides: money sums to 2 places, other reals to 4 or 6.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.session import configure

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; the registered callable first applies the
    engine's runtime settings to whatever session it is given."""
    def register(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            configure(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def r(c: str | Column, places: int = 2, alias: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col.cast("double"), places)
    name = alias or (c if isinstance(c, str) else None)
    return out.alias(name) if name else out


def load_all() -> None:
    """Import every query module so the registry is filled."""
    from tallyframe.plans import (  # noqa: F401
        flagship, q_anomalies, q_cleaning, q_detection, q_forecast, q_insights, q_metrics, q_report, q_streaming,
        q_series, q_sources,
    )
