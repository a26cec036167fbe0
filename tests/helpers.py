"""Small builders for test fixtures (inline rows, like the reference's tests)."""

from __future__ import annotations

from pyspark.sql import functions as F


def cells_from_rows(spark, headers, rows, keys=None):
    """Long cells (position, column, value, rn) for a header list + string rows,
    numbering non-empty values per column in row order (preview mode)."""
    data = []
    counters = {}
    for r_i, row in enumerate(rows):
        for pos, name in enumerate(headers):
            value = row[pos] if pos < len(row) else None
            rn = None
            if value not in (None, ""):
                counters[pos] = counters.get(pos, 0) + 1
                rn = counters[pos]
            data.append((pos, name, value, rn))
    return spark.createDataFrame(data, "position long, column string, value string, rn long")


def frame(spark, columns, rows):
    return spark.createDataFrame(rows, columns)


def collect_dicts(df, order=None):
    if order:
        df = df.orderBy(*order)
    return [r.asDict() for r in df.collect()]


def first(df):
    rows = df.collect()
    assert rows, "empty result"
    return rows[0].asDict()


__all__ = ["F", "cells_from_rows", "collect_dicts", "first", "frame"]
