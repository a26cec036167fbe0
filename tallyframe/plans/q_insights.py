"""Insight queries."""

from __future__ import annotations

from tallyframe.operators import anomalies, forecast, insights, metrics, series
from tallyframe.plans import views
from tallyframe.plans.analyze import analyze
from tallyframe.plans.registry import query, r
from tallyframe.plans.sql_views import SALES, anomaly_ctes, forecast_ctes, points


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tmpl_sql(lang: str, key: str, **exprs: str) -> str:
    """A label template as SQL string concatenation with the given SQL expressions."""
    from tallyframe.operators.labels import label
    text = label(lang, key)
    parts, rest = [], text
    while "{" in rest:
        start = rest.index("{")
        end = rest.index("}", start)
        if start:
            parts.append(q(rest[:start]))
        parts.append(f"({exprs[rest[start + 1:end]]})")
        rest = rest[end + 1:]
    if rest:
        parts.append(q(rest))
    return " || ".join(parts)


def lbl(lang: str, key: str) -> str:
    from tallyframe.operators.labels import label
    return q(label(lang, key))


def series_lbl_sql(lang: str, col: str) -> str:
    return (f"CASE {col} WHEN 'revenue' THEN {lbl(lang, 'header_revenue')} WHEN 'expenses' THEN "
            f"{lbl(lang, 'header_expenses')} WHEN 'profit' THEN {lbl(lang, 'header_profit')} "
            f"ELSE {lbl(lang, 'header_amount')} END")


def pct_sql(x: str) -> str:
    rx = f"round({x}, 1)"
    return f"(CASE WHEN {rx} = floor({rx}) THEN CAST(CAST({rx} AS BIGINT) AS VARCHAR) ELSE CAST({rx} AS VARCHAR) END)"


def money_sql(x: str) -> str:
    return f"replace(format('{{:,.2f}}', {x}), ',', ' ')"


def _last_change_sql(keys: str = "", lang: str = "en") -> str:
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    return f"""lc_r AS (SELECT *, row_number() OVER ({part} ORDER BY period DESC) AS pos FROM p),
lc_g AS (SELECT {k}count(*) AS n, max(CASE WHEN pos = 1 THEN profit END) AS latest,
           max(CASE WHEN pos = 2 THEN profit END) AS previous FROM lc_r WHERE pos <= 2 {g}),
lc AS (SELECT {k}1::BIGINT AS rule_order, 'last_period_change' AS rule, pct AS value,
         CASE WHEN pct >= 0 THEN {tmpl_sql(lang, 'insight_profit_change_up', percent=pct_sql('abs(pct)'))}
              ELSE {tmpl_sql(lang, 'insight_profit_change_down', percent=pct_sql('abs(pct)'))} END AS text
       FROM (SELECT *, CASE WHEN n >= 2 AND abs(previous) > 1e-9 THEN (latest - previous) / abs(previous) * 100 END AS pct FROM lc_g)
       WHERE pct IS NOT NULL)"""


def _half_sql(keys: str = "", lang: str = "en") -> str:
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    return f"""ht_i AS (SELECT *, row_number() OVER ({part} ORDER BY period) - 1 AS idx, count(*) OVER ({part}) AS n FROM p),
ht_g AS (SELECT {k}max(n) AS n, sum(CASE WHEN idx < n // 2 THEN profit ELSE 0.0 END) AS first_half,
           sum(CASE WHEN idx >= n // 2 THEN profit ELSE 0.0 END) AS second_half FROM ht_i {g}),
ht AS (SELECT {k}2::BIGINT AS rule_order, 'half_period_trend' AS rule, pct AS value,
         CASE WHEN pct >= 0 THEN {tmpl_sql(lang, 'insight_half_trend_up', percent=pct_sql('abs(pct)'))}
              ELSE {tmpl_sql(lang, 'insight_half_trend_down', percent=pct_sql('abs(pct)'))} END AS text
       FROM (SELECT *, CASE WHEN n >= 4 AND abs(first_half) > 1e-9 THEN (second_half - first_half) / abs(first_half) * 100 END AS pct FROM ht_g)
       WHERE pct IS NOT NULL)"""


def _cat_sql(lang: str = "en") -> str:
    return f"""cs_c AS (SELECT category, sum(revenue) AS revenue, sum(expenses) AS expenses, sum(revenue - expenses) AS profit FROM sales GROUP BY category),
cs_t AS (SELECT *, row_number() OVER (ORDER BY abs(profit) DESC, category) AS rank FROM cs_c QUALIFY rank <= 25),
cs_g AS (SELECT sum(abs(revenue) + abs(expenses)) AS total, arg_max(category, abs(revenue) + abs(expenses)) AS leader,
           max(abs(revenue) + abs(expenses)) AS lt FROM cs_t),
cs AS (SELECT 3::BIGINT AS rule_order, 'category_concentration' AS rule, lt / total * 100 AS value,
         {tmpl_sql(lang, 'insight_category_share', name='leader', percent=pct_sql('lt / total * 100'))} AS text
       FROM cs_g WHERE total > 1e-9 AND lt / total * 100 >= 25)"""


_CAT_SQL = _cat_sql()

def _burn_sql(lang: str = "en") -> str:
    return f"""bm AS (SELECT (sum(expenses)) / greatest(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1, 1) AS de,
            (sum(revenue) - sum(expenses)) / greatest(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1, 1) AS dp FROM sales),
br AS (SELECT 5::BIGINT AS rule_order, 'burn_rate' AS rule, de AS value, {tmpl_sql(lang, 'insight_burn_rate', value=money_sql('de'))} AS text FROM bm WHERE de > 0
       UNION ALL SELECT 6::BIGINT, 'cash_gap', dp, {tmpl_sql(lang, 'insight_cash_gap', value=money_sql('abs(dp)'))} FROM bm WHERE dp < 0)"""


_BURN_SQL = _burn_sql()


@query("q_last_change", f"""WITH {SALES}, p AS ({points('sales', 'month', 'k')}), {_last_change_sql('k')}
SELECT k AS l_linestatus, rule, round(value, 4) AS value, text FROM lc""")
def q_last_change(spark, sf):
    """Last month's profit against the one before, per line status."""
    led = views.sales(spark, sf, keyed=True)
    out = insights.last_period_change(series.time_series(led, "month"), led.keys)
    return out.select("l_linestatus", "rule", r("value", 4), "text")


@query("q_half_trend", f"""WITH {SALES}, p AS ({points('sales', 'week', 'k')}), {_half_sql('k')}
SELECT k AS l_linestatus, rule, round(value, 4) AS value, text FROM ht""")
def q_half_trend(spark, sf):
    """Second half vs first half of weekly profit, per line status."""
    led = views.sales(spark, sf, keyed=True)
    out = insights.half_period_trend(series.time_series(led, "week"), led.keys)
    return out.select("l_linestatus", "rule", r("value", 4), "text")


@query("q_category_share", f"""WITH {SALES}, {_CAT_SQL}
SELECT rule, round(value, 4) AS value, text FROM cs""")
def q_category_share(spark, sf):
    """I4: share of turnover held by the leading category."""
    led = views.sales(spark, sf)
    out = insights.category_concentration(metrics.top_categories(led, 25), led.keys)
    return out.select("rule", r("value", 4), "text")


@query("q_burn_rate", f"""WITH {SALES}, {_BURN_SQL}
SELECT rule, round(value, 4) AS value, text FROM br""")
def q_burn_rate(spark, sf):
    """Daily burn rate and cash-gap sentences."""
    led = views.sales(spark, sf)
    out = insights.burn_rate_and_cash_gap(metrics.basic_metrics(led), led.keys)
    return out.select("rule", r("value", 4), "text")


def an_sql(grain: str, lang: str = "en") -> str:
    kind = f"CASE kind WHEN 'drop' THEN {lbl(lang, 'anomaly_drop')} ELSE {lbl(lang, 'anomaly_spike')} END"
    text = tmpl_sql(lang, "insight_anomalies", count="CAST(total_found AS VARCHAR)", kind=kind,
                    series=series_lbl_sql(lang, "series"), date="strftime(period, '%d.%m.%Y')")
    return f"""(WITH {anomaly_ctes(SALES, 'sales', grain)}
  SELECT 4::BIGINT AS rule_order, 'anomaly_summary' AS rule, CAST(total_found AS DOUBLE) AS value, {text} AS text
  FROM ar WHERE rank = 1)"""


def fc_sql(grain: str, lang: str = "en") -> str:
    text = tmpl_sql(lang, "insight_forecast", series=series_lbl_sql(lang, "series"), value=money_sql("value"))
    return f"""(WITH {forecast_ctes(SALES, 'sales', grain)}
  SELECT 7::BIGINT AS rule_order, 'forecast_summary' AS rule, value, {text} AS text
  FROM fc WHERE step = 0 AND series IN ('profit', 'amount', 'revenue')
  ORDER BY CASE series WHEN 'profit' THEN 0 WHEN 'amount' THEN 1 ELSE 2 END LIMIT 1)"""


def insights_ctes(grain: str, lang: str = "en") -> str:
    """CTEs (after SALES) ending in ``ins(position, rule, text)`` for the sales ledger."""
    return f"""p AS ({points('sales', grain)}), {_last_change_sql('', lang)}, {_half_sql('', lang)}, {_cat_sql(lang)},
{_burn_sql(lang)},
allr AS (SELECT * FROM lc UNION ALL SELECT * FROM ht UNION ALL SELECT * FROM cs UNION ALL SELECT * FROM br
         UNION ALL SELECT * FROM {an_sql(grain, lang)} UNION ALL SELECT * FROM {fc_sql(grain, lang)}),
ins AS (SELECT row_number() OVER (ORDER BY rule_order)::BIGINT AS position, rule, text FROM allr QUALIFY position <= 6)"""


@query("q_insights", f"""WITH {SALES}, {insights_ctes('month')}
SELECT position, rule, text FROM ins""")
def q_insights(spark, sf):
    """I8: all rules over monthly sales, capped at 6 in rule order."""
    a = analyze(views.sales(spark, sf), grain="month")  # one scan; the rules read its rollup
    out = insights.generate_insights(a.ledger, a.points, a.basic, a.categories, a.anomalies, a.forecast, "en")
    return out.select("position", "rule", "text")
