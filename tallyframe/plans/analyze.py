"""Full analysis as one bundle of lazy DataFrames (O1).

``analyze`` wires prepare → metrics/categories → series → anomalies →
forecast. The three results that read the ledger (period points, totals,
category table) come from ONE grouping-sets aggregate (one scan, one shuffle),
which is small — keys × (1 + categories + periods) rows — and is read by every
later result and report section, so by default it is checkpointed once to the
shared checkpoint folder (``spark.checkpoint.dir``): lineage is cut and a lost
executor costs a re-read of a small table instead of a re-scan of the ledger. ``materialize="persist"`` caches instead; ``None`` keeps it all lazy.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import qcol
from tallyframe.operators import anomalies, forecast, metrics, series
from tallyframe.operators._keys import attach
from tallyframe.operators.partials import raw_rollup
from tallyframe.operators.prepare import prepare
from tallyframe.roles import Ledger, Roles
from tallyframe.session import ensure_checkpoint_dir, staged_table


def _materialize(df: DataFrame, how: str | None) -> DataFrame:
    if how == "checkpoint":
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    if how == "persist":
        return df.persist()
    return df


@dataclass(frozen=True)
class Analysis:
    ledger: Ledger
    grain: str
    week_start: str
    basic: DataFrame
    categories: DataFrame
    points: DataFrame
    visible: DataFrame
    anomalies: DataFrame
    forecast: DataFrame
    horizon: int


def analyze(data: DataFrame | Ledger, roles: Roles | None = None, grain: str = "day",
            week_start: str = "monday", keys: Sequence[str] = (), *,
            category_limit: int | None = metrics.ANALYSIS_CATEGORY_LIMIT,
            anomaly_limit: int | None = anomalies.MAX_ANOMALIES,
            horizon: int = forecast.DEFAULT_PERIODS_AHEAD,
            persist: bool = False, materialize: str | None = "checkpoint") -> Analysis:
    """Build every analysis result for one ledger or many (``keys``)."""
    if isinstance(data, Ledger):
        ledger = data
    else:
        if roles is None or not roles.has_money_column:
            raise ValueError("Select at least one revenue, expense or amount column.")
        ledger = prepare(data, roles.require(data.columns), keys, persist=persist)
    grain = series.normalize_grain(grain)
    week_start = series.normalize_week_start(week_start)
    if materialize:
        # one scan + one shuffle of the ledger for all three, materialised once
        roll = (metrics.ledger_rollup(ledger, grain, week_start) if isinstance(data, Ledger)
                else raw_rollup(data, roles, keys, grain, week_start))
        roll = _materialize(roll, materialize)
        points = metrics.points_from_rollup(roll, ledger)
        basic = metrics.basic_from_rollup(roll, ledger)
        categories = metrics.ranked_categories(metrics.categories_from_rollup(roll, ledger), ledger,
                                               category_limit)
    else:
        points = series.time_series(ledger, grain, week_start)
        basic = metrics.basic_metrics(ledger)
        categories = metrics.top_categories(ledger, category_limit)
    return Analysis(
        ledger=ledger, grain=grain, week_start=week_start,
        basic=basic,
        categories=categories,
        points=points,
        visible=series.visible_series(points, ledger),
        anomalies=anomalies.detect_anomalies(points, ledger, anomaly_limit),
        forecast=forecast.forecast(points, ledger, grain, horizon),
        horizon=horizon,
    )


def file_metrics(spark, paths, roles: Roles, keys: Sequence[str] = ("source_file",)) -> DataFrame:
    """One call from files to totals (S7 ∘ P11 ∘ M1): catalog the files, read only
    the role columns with each file's own settings, prepare, aggregate per file."""
    from tallyframe.sources import files as file_sources
    if not roles.selected():
        raise ValueError("Select at least one column to load.")
    catalog = file_sources.file_catalog(spark, paths)
    df = file_sources.read_ledgers(spark, catalog, columns=list(roles.selected()))
    ledger = prepare(df, roles, keys)
    return metrics.basic_from_rollup(raw_rollup(df, roles, keys), ledger)


@dataclass(frozen=True)
class Fleet:
    """Results for many ledgers, each with its own roles. ``roles`` has a row per key
    and role (``column`` null where none was found); ``basic`` a row per key with its
    roles as text; ``categories`` and ``points`` as for one ledger, by key. Keys
    without a money column are left out."""

    roles: DataFrame
    basic: DataFrame
    categories: DataFrame
    points: DataFrame
    ledger: Ledger


CANONICAL = {"date": "__date", "revenue": "__revenue", "expense": "__expense", "amount": "__amount",
             "category": "__category"}


def auto_analyze(df: DataFrame, keys: Sequence[str] = ("source_file",), grain: str = "day",
                 week_start: str = "monday", members: DataFrame | None = None,
                 category_limit: int | None = metrics.ANALYSIS_CATEGORY_LIMIT) -> Fleet:
    """O2 for a keyed table: detect roles per key from all its rows, then analyse all
    keys together in one pass.

    Each key's chosen columns (five names) are joined to its rows, which then show
    them under one name per role; so a single keyed preparation and rollup serves
    all keys, however many role sets there are. ``members`` (keys, column) restricts
    the detection of a key to its own columns. Files need no such join: see
    ``fleet_analysis``.
    """
    from tallyframe.operators.detection import as_text, detect_roles
    keys = list(keys)
    ensure_checkpoint_dir(df.sparkSession)
    assign, _ = detect_roles(df, keys, members=members)
    assign = assign.checkpoint()
    chosen = _chosen(assign, keys)
    missing = [r[0] for r in assign.where(F.col("column").isNotNull()).select("column").distinct().collect()
               if r[0] not in df.columns]
    if missing:
        raise ValueError(f"Columns not found: {missing}")
    rows = attach(df, chosen, keys).where(F.col("roles").isNotNull())
    columns = [c for c in df.columns if c not in keys]

    def picked(name: str) -> Column:
        return F.coalesce(*[F.when(F.col(name + "_of") == c, as_text(qcol(c), df.schema[c].dataType)) for c in columns])

    canonical = rows.select(*[qcol(k) for k in keys], *[picked(name).alias(name) for name in CANONICAL.values()])
    return _fleet(assign, chosen, canonical, keys, grain, week_start, category_limit)


def _chosen(assign: DataFrame, keys: list[str]) -> DataFrame:
    """Per key with a money column: the column of each role, and the roles as text."""
    chosen = assign.groupBy(*keys).agg(
        *[F.max(F.when(F.col("role") == role, F.col("column"))).alias(name + "_of") for role, name in CANONICAL.items()],
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("column").isNotNull(), F.concat(
            F.col("role"), F.lit("="), F.col("column"))))), ", ").alias("roles"))
    money = [CANONICAL[m] + "_of" for m in ("revenue", "expense", "amount")]
    return chosen.where(F.coalesce(*money).isNotNull())


def _fleet(assign: DataFrame, chosen: DataFrame, canonical: DataFrame, keys: list[str], grain: str, week_start: str,
           category_limit: int | None) -> Fleet:
    ledger = prepare(canonical, Roles(**CANONICAL), keys)
    roll = _materialize(raw_rollup(canonical, Roles(**CANONICAL), keys, grain, week_start, staged=True), "checkpoint")
    basic = attach(metrics.basic_from_rollup(roll, ledger), chosen.select(*keys, "roles"), keys)
    return Fleet(assign, basic,
                 metrics.ranked_categories(metrics.categories_from_rollup(roll, ledger), ledger, category_limit),
                 metrics.points_from_rollup(roll, ledger), ledger)


def fleet_analysis(spark, catalog: DataFrame, grain: str = "day", week_start: str = "monday",
                   category_limit: int | None = metrics.ANALYSIS_CATEGORY_LIMIT) -> Fleet:
    """O2 for the files of a catalog: roles per file from all its rows, each file judged
    on its own columns, then all files analysed in one keyed pass.

    Roles are known before the second read, so the files of one layout and one role set
    are one read that names its columns by role: no ledger row is joined to anything.
    """
    from tallyframe.operators.detection import counted_cells, detect_from_cells
    from tallyframe.sources import files as file_sources
    ensure_checkpoint_dir(spark)
    keys = ["source_file"]
    groups = file_sources.layouts(catalog)
    if not groups:
        raise ValueError("No readable CSV files.")
    # a file with quoted line ends is read by one task, the longest: these come first
    groups.sort(key=lambda g: not g.multi_line)
    cells = staged_table(reduce(DataFrame.unionByName, [
        counted_cells(file_sources.read_layout(spark, g, g.paths), keys) for g in groups]), "cells")

    def exact(names: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [
            counted_cells(file_sources.read_layout(spark, g, g.paths), keys, names, exact=True)
            for g in groups if set(names) & set(g.column_names)])

    assign, _ = detect_from_cells(cells, keys, exact)
    assign = assign.checkpoint()
    chosen = _chosen(assign, keys).checkpoint()
    named = [name + "_of" for name in CANONICAL.values()]
    sets = (catalog.join(chosen, F.col("path") == F.col("source_file"))
            .groupBy(*file_sources.LAYOUT, *named).agg(F.sort_array(F.collect_list("path")).alias("paths")).collect())
    if not sets:
        raise ValueError("No file has a money column.")
    sets.sort(key=lambda g: not g.multi_line)
    parts = []
    for g in sets:
        wanted = [c for c in (g[n] for n in named) if c is not None]
        rows = file_sources.read_layout(spark, g, g.paths, wanted)
        parts.append(rows.select("source_file", *[(qcol(g[n]) if g[n] is not None else F.lit(None).cast("string")).alias(c)
                                                  for n, c in zip(named, CANONICAL.values())]))
    return _fleet(assign, chosen, reduce(DataFrame.unionByName, parts), keys, grain, week_start, category_limit)
