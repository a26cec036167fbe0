"""Report tables (R1-R8, X4) as one long string table per key.

Layout: ``keys…, section_order, section, row_no, col_no, value``. Tables put
their header at ``row_no`` 0. Sections: source 1, summary 2, insights 3,
forecast 4, categories 5, anomalies 6, periods 7; absent sections have no rows.
Every cell is already text in the target language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.format import format_count, format_date, format_money
from tallyframe.operators._keys import attach
from tallyframe.operators.insights import generate_insights
from tallyframe.operators.labels import label, label_col, series_label_col
from tallyframe.operators.series import GRAINS

DEPTH_BRIEF = "brief"
DEPTH_DETAILED = "detailed"
# Fixed values that must equal the reference.
BRIEF_CATEGORY_LIMIT = 5
BRIEF_ANOMALY_LIMIT = 8
SECTIONS = ("source", "summary", "insights", "forecast", "categories", "anomalies", "periods")


def _money(c: Column, language: str) -> Column:
    return format_money(c, label(language, "not_available"))


def _cells(df: DataFrame, keys, section: str, row_no: Column, cells: list[Column]) -> DataFrame:
    """One output row per non-null cell of a table row."""
    arr = F.array(*[F.struct(F.lit(i).cast("bigint").alias("col_no"), c.cast("string").alias("value"))
                    for i, c in enumerate(cells)])
    return df.select(*keys, F.lit(SECTIONS.index(section) + 1).cast("bigint").alias("section_order"),
                     F.lit(section).alias("section"), row_no.cast("bigint").alias("row_no"),
                     F.inline(F.filter(arr, lambda x: x["value"].isNotNull())))


def _pairs(df: DataFrame, keys, section: str, pairs: list[tuple[Column | None, Column, Column]]) -> DataFrame:
    """Label/value section: rows kept when their condition holds, numbered in order."""
    items = F.array(*[F.when(cond if cond is not None else F.lit(True),
                             F.struct(F.lit(lbl).alias("label") if isinstance(lbl, str) else lbl.alias("label"),
                                      val.alias("value")))
                      for cond, lbl, val in pairs])
    rows = df.select(*keys, F.posexplode(F.filter(items, lambda x: x.isNotNull())).alias("pos", "kv"))
    return _cells(rows, keys, section, F.col("pos"), [F.col("kv.label"), F.col("kv.value")])


def period_text(basic: DataFrame) -> Column:
    start, end = format_date(F.col("date_min")), format_date(F.col("date_max"))
    span = F.concat(start, F.lit(" — "), end, F.lit(" ("), format_count(F.col("period_days")), F.lit(")"))
    return F.when(F.col("date_min").isNull() | F.col("date_max").isNull(), F.lit(None)) \
        .when(start == end, start).otherwise(span)


def source_section(basic: DataFrame, keys, file_name: Column | str, grain: str, language: str) -> DataFrame:
    fname = F.lit(file_name) if isinstance(file_name, str) else file_name
    pt = period_text(basic)
    pairs = [(None, F.lit(label(language, "source_file")), fname),
             (pt.isNotNull(), F.lit(label(language, "source_period")), pt),
             (None, F.lit(label(language, "source_transactions")), format_count(F.col("transaction_count")))]
    if grain in GRAINS:
        pairs.append((None, F.lit(label(language, "source_grouping")), F.lit(label(language, f"grouping_{grain}"))))
    return _pairs(basic, keys, "source", pairs)


def summary_section(basic: DataFrame, keys, amount_only: bool, depth: str, language: str) -> DataFrame:
    L = lambda k: F.lit(label(language, k))
    m = lambda c: _money(F.col(c), language)
    pairs = [(None, L("metric_transactions"), format_count(F.col("transaction_count")))]
    if amount_only:
        pairs.append((None, L("metric_amount"), m("total_profit")))
    else:
        pairs += [(None, L("metric_revenue"), m("total_revenue")), (None, L("metric_expenses"), m("total_expenses")),
                  (None, L("metric_profit"), m("total_profit"))]
    pairs.append((F.col("average_daily_profit").isNotNull(), L("metric_average_daily_profit"),
                  m("average_daily_profit")))
    if depth == DEPTH_DETAILED:
        pairs += [(None, L("metric_average_revenue"), m("average_revenue")),
                  (None, L("metric_average_expense"), m("average_expense")),
                  (F.col("period_days").isNotNull(), L("metric_period_days"), format_count(F.col("period_days"))),
                  (F.col("average_daily_revenue").isNotNull(), L("metric_average_daily_revenue"),
                   m("average_daily_revenue")),
                  (F.col("average_daily_expense").isNotNull(), L("metric_average_daily_expense"),
                   m("average_daily_expense")),
                  (None, L("metric_revenue_fields"), format_count(F.col("revenue_column_count"))),
                  (None, L("metric_expense_fields"), format_count(F.col("expense_column_count"))),
                  (None, L("metric_amount_fields"), format_count(F.col("amount_column_count"))),
                  (None, L("metric_category_fields"), format_count(F.col("category_column_count")))]
    return _pairs(basic, keys, "summary", pairs)


def _header(df_keys: DataFrame, keys, section: str, headers: list[str], language: str) -> DataFrame:
    return _cells(df_keys, keys, section, F.lit(0), [F.lit(label(language, h)) for h in headers])


def categories_section(categories: DataFrame, keys, depth: str, language: str) -> DataFrame:
    cats = categories if depth == DEPTH_DETAILED else categories.where(F.col("rank") <= BRIEF_CATEGORY_LIMIT)
    head = _header(cats.select(*keys).distinct(), keys, "categories",
                   ["header_category", "header_transactions", "header_revenue", "header_expenses",
                    "header_profit"], language)
    body = _cells(cats, keys, "categories", F.col("rank"),
                  [F.col("category"), format_count(F.col("transaction_count")),
                   _money(F.col("revenue"), language), _money(F.col("expenses"), language),
                   _money(F.col("profit"), language)])
    return head.unionByName(body)


def anomalies_section(ranked: DataFrame, keys, depth: str, language: str) -> DataFrame:
    rows = ranked if depth == DEPTH_DETAILED else ranked.where(F.col("rank") <= BRIEF_ANOMALY_LIMIT)
    head = _header(rows.select(*keys).distinct(), keys, "anomalies",
                   ["header_period", "header_indicator", "header_kind", "header_value", "header_baseline",
                    "header_severity"], language)
    kind = label_col(language, F.when(F.col("kind") == "drop", F.lit("anomaly_drop")).otherwise(F.lit("anomaly_spike")))
    sev = label_col(language, F.when(F.lower("severity") == "high", F.lit("severity_high"))
                    .otherwise(F.lit("severity_medium")))
    body = _cells(rows, keys, "anomalies", F.col("rank"),
                  [format_date(F.col("period")), series_label_col(language, F.col("series")), kind,
                   _money(F.col("value"), language), _money(F.col("baseline"), language), sev])
    return head.unionByName(body)


def periods_section(points: DataFrame, keys, amount_only: bool, language: str) -> DataFrame:
    # numbering runs over aggregated points only (bounded by the period count)
    from pyspark.sql import Window
    ranked = points.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("period")))
    if amount_only:
        headers, cells = ["header_period", "header_amount"], [format_date(F.col("period")),
                                                            _money(F.col("amount"), language)]
    else:
        headers = ["header_period", "header_revenue", "header_expenses", "header_profit"]
        cells = [format_date(F.col("period")), _money(F.col("revenue"), language),
                 _money(F.col("expenses"), language), _money(F.col("profit"), language)]
    head = _header(points.select(*keys).distinct(), keys, "periods", headers, language)
    return head.unionByName(_cells(ranked, keys, "periods", F.col("pos"), cells))


def forecast_table(forecasts: DataFrame, keys, horizon: int, language: str) -> DataFrame:
    """R6 wide: ``keys…, indicator, step_1…step_h, first_period, method, series_order``."""
    keys = list(keys)
    steps = list(range(horizon))
    wide = (forecasts.withColumn("money", _money(F.col("value"), language))
            .groupBy(*keys, "series", "series_order", "method")
            .pivot("step", steps).agg(F.first("money")))
    firsts = forecasts.where(F.col("step") == 0).groupBy(*keys).agg(
        format_date(F.min("period")).alias("first_period"))
    wide = attach(wide, firsts, keys)
    method = label_col(language, F.concat(F.lit("forecast_method_"), F.col("method")))
    return wide.select(*keys, series_label_col(language, F.col("series")).alias("indicator"),
                       *[F.col(str(s)).alias(f"step_{s + 1}") for s in steps],
                       "first_period", method.alias("method"), "series_order")


def forecast_section(forecasts: DataFrame, keys, horizon: int, language: str) -> DataFrame:
    keys = list(keys)
    wide = forecast_table(forecasts, keys, horizon, language)
    periods = forecasts.groupBy(*keys).pivot("step", list(range(horizon))).agg(format_date(F.min("period")))
    head = _cells(periods, keys, "forecast", F.lit(0),
                  [F.lit(label(language, "header_indicator"))] + [F.col(str(s)) for s in range(horizon)]
                  + [F.lit(label(language, "header_method"))])
    body = _cells(wide, keys, "forecast", F.col("series_order") + 1,
                  [F.col("indicator")] + [F.col(f"step_{s + 1}") for s in range(horizon)] + [F.col("method")])
    return head.unionByName(body)


def insights_section(insights: DataFrame, keys) -> DataFrame:
    return _cells(insights, keys, "insights", F.col("position"), [F.col("text")])


def build_report(analysis, file_name: str = "", depth: str = DEPTH_BRIEF, language: str = "ru") -> DataFrame:
    """Whole report (R8) for an ``Analysis`` bundle as one long DataFrame."""
    led = analysis.ledger
    keys = list(led.keys)
    ins = generate_insights(led, analysis.points, analysis.basic, analysis.categories, analysis.anomalies,
                            analysis.forecast, language)
    parts = [source_section(analysis.basic, keys, file_name, analysis.grain, language),
             summary_section(analysis.basic, keys, led.amount_only, depth, language),
             insights_section(ins, keys),
             forecast_section(analysis.forecast, keys, analysis.horizon, language),
             categories_section(analysis.categories, keys, depth, language),
             anomalies_section(analysis.anomalies, keys, depth, language)]
    if depth == DEPTH_DETAILED:
        parts.append(periods_section(analysis.points, keys, led.amount_only, language))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary_lines(basic: DataFrame, keys, amount_only: bool) -> DataFrame:
    """The compact three-line metric text (English UI)."""
    tx = F.concat(F.lit("Transactions: "), format_count(F.col("transaction_count")))
    if amount_only:
        second = F.concat(F.lit("Amount: "), format_money(F.col("total_profit")))
    else:
        second = (F.when(F.col("total_profit").isNotNull(), F.concat(F.lit("Profit: "), format_money(F.col("total_profit"))))
                  .when(F.col("total_revenue").isNotNull(), F.concat(F.lit("Revenue: "), format_money(F.col("total_revenue"))))
                  .when(F.col("total_expenses").isNotNull(),
                        F.concat(F.lit("Expenses: "), format_money(F.col("total_expenses")))))
    period = F.when(F.col("date_min").isNotNull() & F.col("date_max").isNotNull(),
                    F.concat(F.lit("Period: "), F.date_format("date_min", "yyyy-MM-dd"), F.lit(" - "),
                             F.date_format("date_max", "yyyy-MM-dd")))
    return basic.select(*keys, F.concat_ws("\n", tx, second, period).alias("summary"))


def anomaly_short(ranked: DataFrame, keys, grain: str) -> DataFrame:
    """One short line per anomaly: ``period: Label kind (value)``."""
    from tallyframe.operators.series import period_label
    text = F.concat(period_label(F.col("period"), grain), F.lit(": "), F.col("series_label"), F.lit(" "),
                    F.col("kind"), F.lit(" ("), format_money(F.col("value")), F.lit(")"))
    return ranked.select(*keys, "rank", text.alias("text"))
