"""Period series (T1-T8): points per key and period, visible series, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.roles import Ledger

# Fixed values that must equal the reference: grains, week start days
# (Monday = 0), series keys in display order.
GRAINS = ("hour", "day", "week", "month", "year")
WEEK_STARTS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
SERIES = ("revenue", "expenses", "profit", "amount")
SERIES_LABELS = {"revenue": "Revenue", "expenses": "Expenses", "profit": "Profit", "amount": "Amount"}
MSG_NO_DATE_COLUMN = "Select a date column to build a chart."
MSG_NO_VALID_DATES = "No valid dates found for charting."


def normalize_grain(grain: str) -> str:
    return grain if grain in GRAINS else "day"


def normalize_week_start(week_start: str) -> str:
    return week_start if week_start in WEEK_STARTS else "monday"


def period_start(ts: Column, grain: str, week_start: str = "monday") -> Column:
    """Start of the period containing ``ts`` (timestamp_ntz)."""
    grain = normalize_grain(grain)
    if grain == "week":
        k = WEEK_STARTS.index(normalize_week_start(week_start))
        day = F.to_date(ts)
        return F.date_sub(day, F.pmod(F.weekday(ts) - F.lit(k), F.lit(7))).cast("timestamp_ntz")
    return F.date_trunc(grain, ts).cast("timestamp_ntz")


def time_series(ledger: Ledger, grain: str = "day", week_start: str = "monday") -> DataFrame:
    """Points ``keys…, period, revenue, expenses, profit, amount``.

    Rows without a valid date are left out here (totals keep them); absent sides
    are 0; no gap filling. Partial aggregation runs before the shuffle, so a hot
    key costs one combined row per map task.
    """
    keys = list(ledger.keys)
    df = ledger.df.where(F.col("ts").isNotNull())
    if not ledger.has_dates:
        df = df.where(F.lit(False))
    rev = F.coalesce("revenue", F.lit(0.0))
    exp = F.coalesce("expenses", F.lit(0.0))
    return (df.groupBy(*keys, period_start(F.col("ts"), grain, week_start).alias("period"))
            .agg(F.sum(rev).alias("revenue"), F.sum(exp).alias("expenses"),
                 F.sum(rev - exp).alias("profit"),
                 F.sum(F.coalesce("amount", F.lit(0.0))).alias("amount")))


def series_status(ledger: Ledger) -> DataFrame:
    """Per key: number of dated rows and the chart status message ('' when fine)."""
    return status_from_totals(ledger.df.groupBy(*ledger.keys).agg(F.count("ts").alias("dated_rows")), ledger)


def status_from_totals(agg: DataFrame, ledger: Ledger) -> DataFrame:
    """``series_status`` from per-key aggregates that hold ``dated_rows``."""
    keys = list(ledger.keys)
    # A selected date column without any valid date counts as no date column (the
    # first-valid-date rule finds none); the "no valid dates" text is kept for
    # callers that pass already-parsed dates.
    if not ledger.has_dates:
        msg = F.lit(MSG_NO_DATE_COLUMN)
    else:
        msg = F.when(F.col("dated_rows") == 0, F.lit(MSG_NO_DATE_COLUMN)).otherwise(F.lit(""))
    return agg.select(*keys, "dated_rows", msg.alias("message"))


def _nonzero(c: str) -> Column:
    return F.coalesce(F.bool_or((F.abs(F.col(c)) > 0) & ~F.isnan(F.col(c))), F.lit(False))


def visible_series(points: DataFrame, ledger: Ledger) -> DataFrame:
    """Visible series per key as rows ``keys…, series, series_order``.

    Amount-only ledgers show amount; otherwise revenue and expenses when any
    point is non-zero, profit when both are shown and non-zero, and amount as
    the fallback when nothing else is.
    """
    keys = list(ledger.keys)
    flags = points.groupBy(*keys).agg(*[_nonzero(s).alias("nz_" + s) for s in SERIES])
    arr = _visible_array(ledger, lambda s: F.col("nz_" + s))
    order = F.create_map(*[x for i, s in enumerate(SERIES) for x in (F.lit(s), F.lit(i))])
    return (flags.select(*keys, F.explode(arr).alias("series"))
            .withColumn("series_order", order[F.col("series")].cast("bigint")))


def _visible_array(ledger: Ledger, nz) -> Column:
    """Visible series names from per-key non-zero flags ``nz(series) -> Column``."""
    money = F.lit(ledger.money_selected)
    if ledger.amount_only:
        return F.array(F.lit("amount"))
    rev = F.when(money & nz("revenue"), F.lit("revenue"))
    exp = F.when(money & nz("expenses"), F.lit("expenses"))
    prof = F.when(money & nz("revenue") & nz("expenses") & nz("profit"), F.lit("profit"))
    none_yet = ~(money & (nz("revenue") | nz("expenses")))
    amt = F.when(none_yet & F.lit(ledger.has_amount) & nz("amount"), F.lit("amount"))
    return F.array_compact(F.array(rev, exp, prof, amt))


def long_visible(points: DataFrame, ledger: Ledger) -> DataFrame:
    """Visible long points ``keys…, period, series, series_order, value, n_points``
    without any join: per-key facts (non-zero flags, point count) are window
    aggregates over the key's points, so the points are computed once and
    shuffled once by key (which also serves later ``keys, series`` windows).
    """
    keys = list(ledger.keys)
    w = Window.partitionBy(*keys)
    flags = {s: F.coalesce(F.bool_or((F.abs(F.col(s)) > 0) & ~F.isnan(F.col(s))).over(w), F.lit(False))
             for s in SERIES}
    vis = points.select(*keys, "period", *SERIES, _visible_array(ledger, lambda s: flags[s]).alias("__vis"),
                        F.count(F.lit(1)).over(w).alias("n_points"))
    pairs = F.array(*[F.struct(F.lit(s).alias("series"), F.lit(i).cast("bigint").alias("series_order"),
                               F.col(s).cast("double").alias("value")) for i, s in enumerate(SERIES)])
    long = vis.select(*keys, "period", "n_points", "__vis", F.inline(pairs))
    return long.where(F.array_contains("__vis", F.col("series"))).drop("__vis")


def period_label(period: Column, grain: str) -> Column:
    """Display label per grain: hour → 'yyyy-MM-dd HH:mm', month → 'yyyy-MM', year → 'yyyy', else date."""
    grain = normalize_grain(grain)
    fmt = {"hour": "yyyy-MM-dd HH:mm", "month": "yyyy-MM", "year": "yyyy"}.get(grain, "yyyy-MM-dd")
    return F.date_format(period, fmt)
