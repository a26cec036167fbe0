"""Report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import anomalies, metrics, report, series
from tallyframe.plans import views
from tallyframe.plans.analyze import analyze
from tallyframe.plans.q_insights import money_sql
from tallyframe.plans.registry import query
from tallyframe.plans.sql_views import CASH, SALES, anomaly_ctes


def count_sql(x: str) -> str:
    return f"replace(format('{{:,}}', {x}), ',', ' ')"


@query("q_labels", f"""WITH {anomaly_ctes(SALES, 'sales', 'day')}
SELECT rank, strftime(period, '%d.%m.%Y') AS period_text,
       CASE series WHEN 'revenue' THEN 'Выручка' WHEN 'expenses' THEN 'Расходы' WHEN 'profit' THEN 'Прибыль' ELSE 'Сумма' END AS indicator,
       CASE kind WHEN 'drop' THEN 'провал' ELSE 'всплеск' END AS kind,
       CASE severity WHEN 'High' THEN 'высокая' ELSE 'средняя' END AS severity
FROM ar WHERE rank <= 8""")
def q_labels(spark, sf):
    """Anomaly rows with Russian labels (series, kind, severity)."""
    led = views.sales(spark, sf)
    top = anomalies.detect_anomalies(series.time_series(led, "day"), led, 8)
    sec = report.anomalies_section(top, [], report.DEPTH_BRIEF, "ru").where(F.col("row_no") > 0)
    wide = sec.groupBy("row_no").pivot("col_no", [0, 1, 2, 5]).agg(F.first("value"))
    return wide.select(F.col("row_no").alias("rank"), F.col("0").alias("period_text"), F.col("1").alias("indicator"),
                       F.col("2").alias("kind"), F.col("5").alias("severity"))


def _summary_sql(cte: str, src: str, ledger: str, detailed: bool, amount_only: bool, ru: bool) -> str:
    L = (lambda en, r_: r_) if ru else (lambda en, r_: en)
    na = L("not available", "нет данных")
    money = lambda x: f"coalesce({money_sql(x)}, '{na}')"
    days = "greatest(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1, 1)"
    rows = [f"('{L('Transactions', 'Операций')}', {count_sql('count(*)')}, TRUE)"]
    if amount_only:
        rows.append(f"('{L('Amount', 'Сумма')}', {money('sum(revenue) - sum(expenses)')}, TRUE)")
    else:
        rows += [f"('{L('Revenue', 'Выручка')}', {money('sum(revenue)')}, TRUE)",
                 f"('{L('Expenses', 'Расходы')}', {money('sum(expenses)')}, TRUE)",
                 f"('{L('Profit', 'Прибыль')}', {money('sum(revenue) - sum(expenses)')}, TRUE)"]
    rows.append(f"('{L('Average daily profit', 'Средняя дневная прибыль')}', {money(f'(sum(revenue) - sum(expenses)) / {days}')}, min(ts) IS NOT NULL)")
    if detailed:
        rows += [f"('{L('Average revenue per transaction', 'Средняя выручка на операцию')}', {money('sum(revenue) / count(*)')}, TRUE)",
                 f"('{L('Average expense per transaction', 'Средний расход на операцию')}', {money('sum(expenses) / count(*)')}, TRUE)",
                 f"('{L('Days in period', 'Дней в периоде')}', {count_sql(days)}, min(ts) IS NOT NULL)",
                 f"('{L('Average daily revenue', 'Средняя дневная выручка')}', {money(f'sum(revenue) / {days}')}, min(ts) IS NOT NULL)",
                 f"('{L('Average daily expense', 'Средний дневной расход')}', {money(f'sum(expenses) / {days}')}, min(ts) IS NOT NULL)",
                 f"('{L('Revenue fields', 'Колонок выручки')}', '1', TRUE)",
                 f"('{L('Expense fields', 'Колонок расходов')}', '1', TRUE)",
                 f"('{L('Amount fields', 'Колонок суммы')}', '0', TRUE)",
                 f"('{L('Category fields', 'Колонок категорий')}', '1', TRUE)"]
    arr = ", ".join(f"{{'label': {r_[1:r_.index(',')]}, 'value': {r_[r_.index(',') + 2:r_.rindex(',')]}, 'keep': {r_[r_.rindex(',') + 2:-1]}}}"
                    for r_ in rows)
    return (f"(WITH {cte}, agg AS (SELECT [{arr}] AS items FROM {src}), "
            f"kept AS (SELECT list_filter(items, lambda x: x.keep) AS items FROM agg) "
            f"SELECT '{ledger}' AS ledger, (i - 1)::BIGINT AS row_no, items[i].label AS label, items[i].value AS value "
            f"FROM kept, range(1, len(items) + 1) t(i))")


@query("q_report_summary", _summary_sql(SALES, "sales", "sales_detailed_en", True, False, False)
       + "\nUNION ALL\n" + _summary_sql(CASH, "cash", "cash_brief_ru", False, True, True))
def q_report_summary(spark, sf):
    """R2: summary rows, detailed (two-sided, English) and brief (amount-only, Russian)."""
    out = None
    for name, led, depth, lang in (("sales_detailed_en", views.sales(spark, sf), report.DEPTH_DETAILED, "en"),
                                   ("cash_brief_ru", views.cash(spark, sf), report.DEPTH_BRIEF, "ru")):
        sec = report.summary_section(metrics.basic_metrics(led), [], led.amount_only, depth, lang)
        wide = sec.groupBy("row_no").pivot("col_no", [0, 1]).agg(F.first("value"))
        wide = wide.select(F.lit(name).alias("ledger"), "row_no", F.col("0").alias("label"), F.col("1").alias("value"))
        out = wide if out is None else out.unionByName(wide)
    return out


@query("q_report_periods", f"""WITH {SALES}, p AS (SELECT CAST(date_trunc('month', ts) AS TIMESTAMP) AS period,
       sum(revenue) AS revenue, sum(expenses) AS expenses, sum(revenue - expenses) AS profit FROM sales GROUP BY 1),
rows AS (SELECT row_number() OVER (ORDER BY period)::BIGINT AS row_no, strftime(period, '%d.%m.%Y') AS c0,
       {money_sql('revenue')} AS c1, {money_sql('expenses')} AS c2, {money_sql('profit')} AS c3 FROM p)
SELECT 0::BIGINT AS row_no, 0::BIGINT AS col_no, 'Period' AS value UNION ALL SELECT 0, 1, 'Revenue'
UNION ALL SELECT 0, 2, 'Expenses' UNION ALL SELECT 0, 3, 'Profit'
UNION ALL SELECT row_no, 0, c0 FROM rows UNION ALL SELECT row_no, 1, c1 FROM rows
UNION ALL SELECT row_no, 2, c2 FROM rows UNION ALL SELECT row_no, 3, c3 FROM rows""")
def q_report_periods(spark, sf):
    """The detailed report's period table (monthly sales, English)."""
    led = views.sales(spark, sf)
    sec = report.periods_section(series.time_series(led, "month"), [], False, "en")
    return sec.select("row_no", "col_no", "value")


@query("q_summary_lines", f"""WITH {SALES}, {CASH}
SELECT 'sales' AS ledger, 'Transactions: ' || {count_sql('count(*)')} || chr(10) || 'Profit: ' || {money_sql('sum(revenue) - sum(expenses)')}
       || chr(10) || 'Period: ' || strftime(min(ts), '%Y-%m-%d') || ' - ' || strftime(max(ts), '%Y-%m-%d') AS summary FROM sales
UNION ALL
SELECT 'cash', 'Transactions: ' || {count_sql('count(*)')} || chr(10) || 'Amount: ' || {money_sql('sum(revenue) - sum(expenses)')}
       || chr(10) || 'Period: ' || strftime(min(ts), '%Y-%m-%d') || ' - ' || strftime(max(ts), '%Y-%m-%d') FROM cash""")
def q_summary_lines(spark, sf):
    """Compact three-line metric text for a two-sided and an amount-only ledger."""
    out = None
    for name, led in (("sales", views.sales(spark, sf)), ("cash", views.cash(spark, sf))):
        s = report.summary_lines(metrics.basic_metrics(led), [], led.amount_only)
        s = s.select(F.lit(name).alias("ledger"), "summary")
        out = s if out is None else out.unionByName(s)
    return out


@query("q_anomaly_lines", f"""WITH {anomaly_ctes(SALES, 'sales', 'week')}
SELECT rank, strftime(period, '%Y-%m-%d') || ': ' || series_label || ' ' || kind || ' (' || {money_sql('value')} || ')' AS text
FROM ar WHERE rank <= 8""")
def q_anomaly_lines(spark, sf):
    """One short line per anomaly (weekly sales), as in the compact panel."""
    led = views.sales(spark, sf)
    top = anomalies.detect_anomalies(series.time_series(led, "week"), led, 8)
    return report.anomaly_short(top, [], "week")


@query("q_report_source", f"""WITH {SALES}, s AS (SELECT count(*) AS n, min(ts) AS a, max(ts) AS b,
       greatest(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1, 1) AS d FROM sales)
SELECT 0::BIGINT AS row_no, 'Файл' AS label, 'lineitem.parquet' AS value FROM s
UNION ALL SELECT 1, 'Период', strftime(a, '%d.%m.%Y') || ' — ' || strftime(b, '%d.%m.%Y') || ' (' || {count_sql('d')} || ')' FROM s
UNION ALL SELECT 2, 'Операций', {count_sql('n')} FROM s
UNION ALL SELECT 3, 'Группировка', 'по неделям' FROM s""")
def q_report_source(spark, sf):
    """The source section (Russian) of a weekly sales report."""
    led = views.sales(spark, sf)
    sec = report.source_section(metrics.basic_metrics(led), [], "lineitem.parquet", "week", "ru")
    wide = sec.groupBy("row_no").pivot("col_no", [0, 1]).agg(F.first("value"))
    return wide.select("row_no", F.col("0").alias("label"), F.col("1").alias("value"))


@query("q_report_categories", f"""WITH {SALES}, c AS (
  SELECT l_partkey::VARCHAR AS category, count(*) AS n, sum(revenue) AS rv, sum(expenses) AS ex,
         sum(revenue - expenses) AS pf FROM sales GROUP BY l_partkey),
t AS (SELECT *, row_number() OVER (ORDER BY abs(pf) DESC, category) AS rn FROM c QUALIFY rn <= 5)
SELECT 0::BIGINT AS row_no, 0::BIGINT AS col_no, 'Category' AS value UNION ALL SELECT 0, 1, 'Transactions'
UNION ALL SELECT 0, 2, 'Revenue' UNION ALL SELECT 0, 3, 'Expenses' UNION ALL SELECT 0, 4, 'Profit'
UNION ALL SELECT rn, 0, category FROM t UNION ALL SELECT rn, 1, {count_sql('n')} FROM t
UNION ALL SELECT rn, 2, {money_sql('round(rv, 2)')} FROM t UNION ALL SELECT rn, 3, {money_sql('round(ex, 2)')} FROM t
UNION ALL SELECT rn, 4, {money_sql('round(pf, 2)')} FROM t""")
def q_report_categories(spark, sf):
    """The brief category table (top 5 of all parts by |profit|), English."""
    li = views.table(spark, sf, "lineitem").withColumn("expense_value", views.sales_expense())
    from tallyframe.operators.prepare import prepare
    from tallyframe.roles import Roles
    led = prepare(li, Roles(date="l_shipdate", revenue="l_extendedprice", expense="expense_value",
                            category="l_partkey"))
    cats = metrics.top_categories(led, 25).withColumn("revenue", F.round("revenue", 2)) \
        .withColumn("expenses", F.round("expenses", 2)).withColumn("profit", F.round("profit", 2))
    return report.categories_section(cats, [], report.DEPTH_BRIEF, "en").select("row_no", "col_no", "value")


def _report_sql(lang: str = "en") -> str:
    """DuckDB text of the brief weekly sales report in ``lang``, long form."""
    from tallyframe.plans.q_insights import insights_ctes, lbl, series_lbl_sql
    from tallyframe.plans.sql_views import forecast_ctes
    days = "greatest(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1, 1)"
    money = money_sql
    L = lambda key: lbl(lang, key)

    def cell(order, section, row, col, value):
        return (f"SELECT {order}::BIGINT AS section_order, '{section}' AS section, {row}::BIGINT AS row_no, "
                f"{col}::BIGINT AS col_no, {value} AS value FROM m")

    period = f"strftime(a, '%d.%m.%Y') || ' — ' || strftime(b, '%d.%m.%Y') || ' (' || {count_sql('d')} || ')'"
    src = " UNION ALL ".join([
        cell(1, "source", 0, 0, L("source_file")), cell(1, "source", 0, 1, "'lineitem.parquet'"),
        cell(1, "source", 1, 0, L("source_period")), cell(1, "source", 1, 1, period),
        cell(1, "source", 2, 0, L("source_transactions")), cell(1, "source", 2, 1, count_sql("n")),
        cell(1, "source", 3, 0, L("source_grouping")), cell(1, "source", 3, 1, L("grouping_week"))])
    summ = " UNION ALL ".join([
        cell(2, "summary", 0, 0, L("metric_transactions")), cell(2, "summary", 0, 1, count_sql("n")),
        cell(2, "summary", 1, 0, L("metric_revenue")), cell(2, "summary", 1, 1, money("rv")),
        cell(2, "summary", 2, 0, L("metric_expenses")), cell(2, "summary", 2, 1, money("ex")),
        cell(2, "summary", 3, 0, L("metric_profit")), cell(2, "summary", 3, 1, money("rv - ex")),
        cell(2, "summary", 4, 0, L("metric_average_daily_profit")), cell(2, "summary", 4, 1, money("(rv - ex) / d"))])
    method = (f"CASE method WHEN 'linear_trend' THEN {L('forecast_method_linear_trend')} "
              f"ELSE {L('forecast_method_moving_average')} END")
    fc = f"""(WITH {forecast_ctes(SALES, 'sales', 'week')},
      hdr AS (SELECT step, strftime(min(period), '%d.%m.%Y') AS d FROM fc GROUP BY step)
      SELECT 4::BIGINT, 'forecast', 0::BIGINT, 0::BIGINT, {L('header_indicator')}
      UNION ALL SELECT 4, 'forecast', 0, step + 1, d FROM hdr
      UNION ALL SELECT 4, 'forecast', 0, 4, {L('header_method')}
      UNION ALL SELECT 4, 'forecast', series_order + 1, 0, {series_lbl_sql(lang, 'series')} FROM fc WHERE step = 0
      UNION ALL SELECT 4, 'forecast', series_order + 1, step + 1, {money('value')} FROM fc
      UNION ALL SELECT 4, 'forecast', series_order + 1, 4, {method} FROM fc WHERE step = 0)"""
    an_heads = ", ".join(f"({i}, {L(k)})" for i, k in enumerate(
        ["header_period", "header_indicator", "header_kind", "header_value", "header_baseline", "header_severity"]))
    kind = f"CASE kind WHEN 'drop' THEN {L('anomaly_drop')} ELSE {L('anomaly_spike')} END"
    sev = f"CASE severity WHEN 'High' THEN {L('severity_high')} ELSE {L('severity_medium')} END"
    an = f"""(WITH {anomaly_ctes(SALES, 'sales', 'week')}
      SELECT 6::BIGINT, 'anomalies', 0::BIGINT, c::BIGINT, h FROM (VALUES {an_heads}) t(c, h)
             WHERE (SELECT count(*) FROM ar) > 0
      UNION ALL SELECT 6, 'anomalies', rank, 0, strftime(period, '%d.%m.%Y') FROM ar WHERE rank <= 8
      UNION ALL SELECT 6, 'anomalies', rank, 1, {series_lbl_sql(lang, 'series')} FROM ar WHERE rank <= 8
      UNION ALL SELECT 6, 'anomalies', rank, 2, {kind} FROM ar WHERE rank <= 8
      UNION ALL SELECT 6, 'anomalies', rank, 3, {money('value')} FROM ar WHERE rank <= 8
      UNION ALL SELECT 6, 'anomalies', rank, 4, {money('baseline')} FROM ar WHERE rank <= 8
      UNION ALL SELECT 6, 'anomalies', rank, 5, {sev} FROM ar WHERE rank <= 8)"""
    cat_heads = ", ".join(f"({i}, {L(k)})" for i, k in enumerate(
        ["header_category", "header_transactions", "header_revenue", "header_expenses", "header_profit"]))
    return f"""WITH {SALES}, {insights_ctes('week', lang)},
m AS (SELECT count(*) AS n, sum(revenue) AS rv, sum(expenses) AS ex, min(ts) AS a, max(ts) AS b, {days} AS d FROM sales),
c AS (SELECT category, count(*) AS cn, sum(revenue) AS crv, sum(expenses) AS cex, sum(revenue - expenses) AS cpf,
        row_number() OVER (ORDER BY abs(sum(revenue - expenses)) DESC, category) AS rank FROM sales GROUP BY category),
cb AS (SELECT * FROM c WHERE rank <= 5)
{src}
UNION ALL {summ}
UNION ALL SELECT 3, 'insights', position, 0, text FROM ins
UNION ALL SELECT * FROM {fc}
UNION ALL SELECT 5::BIGINT, 'categories', 0::BIGINT, c::BIGINT, h FROM (VALUES {cat_heads}) t(c, h)
UNION ALL SELECT 5, 'categories', rank, 0, category FROM cb
UNION ALL SELECT 5, 'categories', rank, 1, {count_sql('cn')} FROM cb
UNION ALL SELECT 5, 'categories', rank, 2, {money('crv')} FROM cb
UNION ALL SELECT 5, 'categories', rank, 3, {money('cex')} FROM cb
UNION ALL SELECT 5, 'categories', rank, 4, {money('cpf')} FROM cb
UNION ALL SELECT * FROM {an}"""


@query("q_report_brief", _report_sql())
def q_report_brief(spark, sf):
    """The brief English report of weekly sales, every section, as one long table."""
    a = analyze(views.sales(spark, sf), grain="week")
    return report.build_report(a, "lineitem.parquet", report.DEPTH_BRIEF, "en").select(
        "section_order", "section", "row_no", "col_no", "value")


@query("q_report_rows", _report_sql("ru"))
def q_report_rows(spark, sf):
    """The whole brief Russian report of weekly sales as one long table (rows-only check)."""
    led = views.sales(spark, sf)
    a = analyze(led, grain="week")
    return report.build_report(a, "lineitem.parquet", report.DEPTH_BRIEF, "ru")


def _report_keyed_sql(lang: str = "en", grain: str = "month") -> str:
    """DuckDB text of the detailed report per line status (key column ``k``)."""
    from tallyframe.plans.q_insights import (
        _half_sql, _last_change_sql, lbl, pct_sql, series_lbl_sql, tmpl_sql,
    )
    from tallyframe.plans.sql_views import forecast_ctes, points
    L = lambda key: lbl(lang, key)
    money = money_sql
    days = "greatest(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1, 1)"

    def cells(order, section, rows):
        """rows: (row_no, col_no, value sql) over m (one row per key)."""
        return " UNION ALL ".join(
            f"SELECT k, {order}::BIGINT AS section_order, '{section}' AS section, {r}::BIGINT AS row_no, "
            f"{c}::BIGINT AS col_no, {v} AS value FROM m" for r, c, v in rows)

    period = f"strftime(a, '%d.%m.%Y') || ' — ' || strftime(b, '%d.%m.%Y') || ' (' || {count_sql('d')} || ')'"
    src = cells(1, "source", [(0, 0, L("source_file")), (0, 1, "'lineitem.parquet'"), (1, 0, L("source_period")),
                              (1, 1, period), (2, 0, L("source_transactions")), (2, 1, count_sql("n")),
                              (3, 0, L("source_grouping")), (3, 1, L(f"grouping_{grain}"))])
    summary_rows = [("metric_transactions", count_sql("n")), ("metric_revenue", money("rv")),
                    ("metric_expenses", money("ex")), ("metric_profit", money("rv - ex")),
                    ("metric_average_daily_profit", money("(rv - ex) / d")),
                    ("metric_average_revenue", money("rv / n")), ("metric_average_expense", money("ex / n")),
                    ("metric_period_days", count_sql("d")), ("metric_average_daily_revenue", money("rv / d")),
                    ("metric_average_daily_expense", money("ex / d")), ("metric_revenue_fields", "'1'"),
                    ("metric_expense_fields", "'1'"), ("metric_amount_fields", "'0'"), ("metric_category_fields", "'1'")]
    summ = cells(2, "summary", [x for i, (key, v) in enumerate(summary_rows) for x in ((i, 0, L(key)), (i, 1, v))])
    kind = f"CASE kind WHEN 'drop' THEN {L('anomaly_drop')} ELSE {L('anomaly_spike')} END"
    an_text = tmpl_sql(lang, "insight_anomalies", count="CAST(total_found AS VARCHAR)", kind=kind,
                       series=series_lbl_sql(lang, "series"), date="strftime(period, '%d.%m.%Y')")
    fc_text = tmpl_sql(lang, "insight_forecast", series=series_lbl_sql(lang, "series"), value=money("value"))
    method = (f"CASE method WHEN 'linear_trend' THEN {L('forecast_method_linear_trend')} "
              f"ELSE {L('forecast_method_moving_average')} END")
    sev = f"CASE severity WHEN 'High' THEN {L('severity_high')} ELSE {L('severity_medium')} END"
    an_heads = ", ".join(f"({i}, {L(h)})" for i, h in enumerate(
        ["header_period", "header_indicator", "header_kind", "header_value", "header_baseline", "header_severity"]))
    cat_heads = ", ".join(f"({i}, {L(h)})" for i, h in enumerate(
        ["header_category", "header_transactions", "header_revenue", "header_expenses", "header_profit"]))
    per_heads = ", ".join(f"({i}, {L(h)})" for i, h in enumerate(
        ["header_period", "header_revenue", "header_expenses", "header_profit"]))
    fc_block = f"""(WITH {forecast_ctes(SALES, 'sales', grain, keys='k')}
      SELECT k, 4::BIGINT, 'forecast', 0::BIGINT, 0::BIGINT, {L('header_indicator')} FROM (SELECT DISTINCT k FROM fc)
      UNION ALL SELECT k, 4, 'forecast', 0, step + 1, strftime(min(period), '%d.%m.%Y') FROM fc GROUP BY k, step
      UNION ALL SELECT k, 4, 'forecast', 0, 4, {L('header_method')} FROM (SELECT DISTINCT k FROM fc)
      UNION ALL SELECT k, 4, 'forecast', series_order + 1, 0, {series_lbl_sql(lang, 'series')} FROM fc WHERE step = 0
      UNION ALL SELECT k, 4, 'forecast', series_order + 1, step + 1, {money('value')} FROM fc
      UNION ALL SELECT k, 4, 'forecast', series_order + 1, 4, {method} FROM fc WHERE step = 0)"""
    an_block = f"""(WITH {anomaly_ctes(SALES, 'sales', grain, keys='k')}
      SELECT k, 6::BIGINT, 'anomalies', 0::BIGINT, c::BIGINT, h FROM (SELECT DISTINCT k FROM ar), (VALUES {an_heads}) t(c, h)
      UNION ALL SELECT k, 6, 'anomalies', rank, 0, strftime(period, '%d.%m.%Y') FROM ar WHERE rank <= 8
      UNION ALL SELECT k, 6, 'anomalies', rank, 1, {series_lbl_sql(lang, 'series')} FROM ar WHERE rank <= 8
      UNION ALL SELECT k, 6, 'anomalies', rank, 2, {kind} FROM ar WHERE rank <= 8
      UNION ALL SELECT k, 6, 'anomalies', rank, 3, {money('value')} FROM ar WHERE rank <= 8
      UNION ALL SELECT k, 6, 'anomalies', rank, 4, {money('baseline')} FROM ar WHERE rank <= 8
      UNION ALL SELECT k, 6, 'anomalies', rank, 5, {sev} FROM ar WHERE rank <= 8)"""
    an_ins = f"""(WITH {anomaly_ctes(SALES, 'sales', grain, keys='k')}
      SELECT k, 4::BIGINT AS rule_order, 'anomaly_summary' AS rule, CAST(total_found AS DOUBLE) AS value, {an_text} AS text
      FROM ar WHERE rank = 1)"""
    fc_ins = f"""(WITH {forecast_ctes(SALES, 'sales', grain, keys='k')}
      SELECT k, 7::BIGINT AS rule_order, 'forecast_summary' AS rule, value, {fc_text} AS text FROM fc
      WHERE step = 0 AND series IN ('profit', 'amount', 'revenue')
      QUALIFY row_number() OVER (PARTITION BY k ORDER BY CASE series WHEN 'profit' THEN 0 WHEN 'amount' THEN 1 ELSE 2 END) = 1)"""
    return f"""WITH {SALES}, p AS ({points('sales', grain, 'k')}), {_last_change_sql('k', lang)}, {_half_sql('k', lang)},
m AS (SELECT k, count(*) AS n, sum(revenue) AS rv, sum(expenses) AS ex, min(ts) AS a, max(ts) AS b, {days} AS d
      FROM sales GROUP BY k),
c AS (SELECT k, category, count(*) AS cn, sum(revenue) AS crv, sum(expenses) AS cex, sum(revenue - expenses) AS cpf,
        row_number() OVER (PARTITION BY k ORDER BY abs(sum(revenue - expenses)) DESC, category) AS rank
      FROM sales GROUP BY k, category),
cb AS (SELECT * FROM c WHERE rank <= 25),
cs_g AS (SELECT k, sum(abs(crv) + abs(cex)) AS total, arg_max(category, abs(crv) + abs(cex)) AS leader,
           max(abs(crv) + abs(cex)) AS lt FROM cb GROUP BY k),
cs AS (SELECT k, 3::BIGINT AS rule_order, 'category_concentration' AS rule, lt / total * 100 AS value,
         {tmpl_sql(lang, 'insight_category_share', name='leader', percent=pct_sql('lt / total * 100'))} AS text
       FROM cs_g WHERE total > 1e-9 AND lt / total * 100 >= 25),
br AS (SELECT k, 5::BIGINT AS rule_order, 'burn_rate' AS rule, ex / d AS value,
         {tmpl_sql(lang, 'insight_burn_rate', value=money('ex / d'))} AS text FROM m WHERE ex / d > 0
       UNION ALL SELECT k, 6::BIGINT, 'cash_gap', (rv - ex) / d,
         {tmpl_sql(lang, 'insight_cash_gap', value=money('abs((rv - ex) / d)'))} FROM m WHERE (rv - ex) / d < 0),
allr AS (SELECT * FROM lc UNION ALL SELECT * FROM ht UNION ALL SELECT * FROM cs UNION ALL SELECT * FROM br
         UNION ALL SELECT * FROM {an_ins} UNION ALL SELECT * FROM {fc_ins}),
ins AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY rule_order)::BIGINT AS position, text FROM allr
        QUALIFY position <= 6),
pr AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY period) AS rn FROM p)
SELECT k AS l_linestatus, section_order, section, row_no, col_no, value FROM (
{src}
UNION ALL {summ}
UNION ALL SELECT k, 3, 'insights', position, 0, text FROM ins
UNION ALL SELECT * FROM {fc_block}
UNION ALL SELECT k, 5::BIGINT, 'categories', 0::BIGINT, c::BIGINT, h FROM (SELECT DISTINCT k FROM cb), (VALUES {cat_heads}) t(c, h)
UNION ALL SELECT k, 5, 'categories', rank, 0, category FROM cb
UNION ALL SELECT k, 5, 'categories', rank, 1, {count_sql('cn')} FROM cb
UNION ALL SELECT k, 5, 'categories', rank, 2, {money('crv')} FROM cb
UNION ALL SELECT k, 5, 'categories', rank, 3, {money('cex')} FROM cb
UNION ALL SELECT k, 5, 'categories', rank, 4, {money('cpf')} FROM cb
UNION ALL SELECT * FROM {an_block}
UNION ALL SELECT k, 7::BIGINT, 'periods', 0::BIGINT, c::BIGINT, h FROM (SELECT DISTINCT k FROM pr), (VALUES {per_heads}) t(c, h)
UNION ALL SELECT k, 7, 'periods', rn, 0, strftime(period, '%d.%m.%Y') FROM pr
UNION ALL SELECT k, 7, 'periods', rn, 1, {money('revenue')} FROM pr
UNION ALL SELECT k, 7, 'periods', rn, 2, {money('expenses')} FROM pr
UNION ALL SELECT k, 7, 'periods', rn, 3, {money('profit')} FROM pr)"""


@query("q_report_keyed", _report_keyed_sql("en", "month"))
def q_report_keyed(spark, sf):
    """R8 per key: detailed English report of monthly sales for each line status."""
    led = views.sales(spark, sf, keyed=True)
    a = analyze(led, grain="month")
    return report.build_report(a, "lineitem.parquet", report.DEPTH_DETAILED, "en")
